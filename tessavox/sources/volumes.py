"""Reading and writing volumes in files. Files are read by Spark (any file system), decoded where they are, one at a time.

A volume of several files is their slices in the order of names. Readers give one row for each slice and column block;
``read_volume`` explodes these into voxels in the JVM.
"""

from __future__ import annotations

import functools
import json
import os
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavox.functions import paths
from tessavox.operators import predict, resample, tiling
from tessavox.operators.grouped import worked
from tessavox.operators.lineage import cut
from tessavox.sources import codecs, ranges

SLICES = "path string, z long, y0 long, x0 long, height long, width long, dtype string, data array<double>"


def _emit(path: str, a: np.ndarray, z0: int, y0: int, x0: int) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in SLICES.split(", ")]
    for i, page in enumerate(a):
        flat = pa.array(np.ascontiguousarray(page, np.float64).ravel())
        data = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        one = [pa.array([v], pa.int64()) for v in (z0 + i, y0, x0, page.shape[0], page.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array([path]), *one, pa.array([a.dtype.name]), data], names)


def _files(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """path, suffix, content of readable files, images that Spark decodes itself left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    return found.select("path", paths.suffix(F.col("path")).alias("suffix"), "content").where("suffix NOT IN ('', '.jpg')")


def _pictures(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """path, height, width, channels, data of JPEG files, by Spark's own image source."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][pP][gG]").load(where)
    return found.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def slices(spark: SparkSession, path: str | list[str], kinds: tuple[bool, bool, int] | None = None) -> DataFrame:
    """SLICES of the readable files below a path (or of some files); z counts within each file. Zarr stores give a row for each chunk's slice.

    JPEG files must be grey; colours that agree in all channels count as grey. ``kinds`` is what _kinds() says, if known.
    """
    if isinstance(path, str) and paths.resolve(path) == "zarr":
        return _zarr(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, s, c in zip(*b.columns, strict=True):
                yield from _emit(p.as_py(), codecs.decode(c.as_py(), s.as_py()), 0, 0, 0)

    def grey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, h, w, n, data in zip(*b.columns, strict=True):
                a = np.frombuffer(data.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), n.as_py())
                if (a[:, :, :3] != a[:, :, :1]).any():
                    raise ValueError(f"{p.as_py()} is a colour image")
                yield from _emit(p.as_py(), a[None, :, :, 0], 0, 0, 0)

    both = kinds or _kinds(spark, path)
    out = [_files(spark, path).mapInArrow(run, SLICES)] * both[0] + [_pictures(spark, path).mapInArrow(grey, SLICES)] * both[1]
    return out[0] if len(out) == 1 else out[0].union(out[1])


def _kinds(spark: SparkSession, path: str | list[str]) -> tuple[bool, bool, int]:
    """Whether there are files besides JPEG (or none at all), and JPEG files, and how many files: by the listing, nothing is read. A
    task lists what Arrow reaches, a row comes back; elsewhere Spark lists on the driver."""
    if isinstance(path, str) and ranges.reachable(path):
        n, jpg = ranges.names(spark, path).agg(F.count("*"), F.count_if(F.lower("file").endswith(".jpg"))).first()
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
        n, jpg = len(listed), sum(f.lower().endswith(".jpg") for f in listed)
    return jpg < n or not jpg, jpg > 0, n


def _zarr_array(spark: SparkSession, path: str) -> tuple[str, dict]:
    """Root and metadata of a store, or of a group's array 0 or else its first: one small text file."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    inner = sorted(x.getPath().getName() for x in fs.listStatus(top) if x.isDirectory())
    for name in ["", *sorted(inner, key=lambda n: (n != "0", n))]:  # Spark's own readers skip names with a leading dot
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}".rstrip("/") + "/.zarray")
        if fs.exists(at):
            stream = fs.open(at)
            text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            stream.close()
            return f"{path}/{name}".rstrip("/"), json.loads(text)
    raise ValueError(f"no Zarr array below {path}")


def _zarr(spark: SparkSession, path: str, z: tuple[int, int] | None = None) -> DataFrame:
    root, meta = _zarr_array(spark, path)
    tail = "/".join(root.rstrip("/").split("/")[-2:]) + "/"
    shape, chunks = meta["shape"], meta["chunks"]
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if z is not None and len(shape) == 3 and meta.get("dimension_separator", ".") == ".":  # names of chunks begin with the number along z
        wanted = "|".join(str(i) for i in range(z[0] // chunks[0], -(-z[1] // chunks[0])))
        found = found.option("pathGlobFilter", "{" + wanted.replace("|", ".*,") + ".*}") if wanted else found.option("pathGlobFilter", "none")
    found = found.load(root).select("path", "content").where(name.rlike(r"^[0-9]+(\.[0-9]+)*$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = [int(i) for i in p[p.rindex(tail) + len(tail) :].replace("/", ".").split(".")]
                a = codecs.read_chunk(c.as_py(), meta)
                lo = [i * n for i, n in zip(at, chunks, strict=True)]
                cut = a[tuple(slice(0, max(0, min(n, s - o))) for n, s, o in zip(chunks, shape, lo, strict=True))]
                yield from _emit(p, codecs.as_volume(cut), *([0] * (3 - len(lo)) + lo))

    return found.mapInArrow(run, SLICES)


def _ranged(path: str, kinds: tuple[bool, bool, int]) -> bool:
    """Whether the files' own places can be read: Arrow reaches them, and none is a JPEG file."""
    return ranges.reachable(path) and not kinds[1]


def headers(spark: SparkSession, path: str, kinds: tuple[bool, bool, int] | None = None) -> DataFrame:
    """file, dz, height, width, dtype of each file of a stack, from a few kilobytes of it; no pixel is read (but of JPEG files, and on
    file systems that only Spark reaches)."""
    kinds = kinds or _kinds(spark, path)
    if _ranged(path, kinds):
        return ranges.headed(spark, path, kinds[2]).select(*[c.split(" ")[0] for c in ranges.HEADERS.split(", ")])
    kind = "file string, dz long, height long, width long, dtype string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(p.as_py(), *codecs.header(c.as_py(), s.as_py())) for p, s, c in zip(*b.columns, strict=True)]
            if found:
                types = [pa.string(), *[pa.int64()] * 3, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), types, strict=True)], [f.split(" ")[0] for f in kind.split(", ")])

    pictures = lambda: _pictures(spark, path).select(F.col("path").alias("file"), F.lit(1).cast("long").alias("dz"), F.col("height").cast("long"), F.col("width").cast("long"), F.lit("uint8").alias("dtype"))
    out = [_files(spark, path).mapInArrow(run, kind)] * kinds[0] + [pictures()] * kinds[1]
    return out[0] if len(out) == 1 else out[0].union(out[1])


def shape_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Depth, height and width of a volume, from headers."""
    if paths.resolve(path) == "zarr":
        shape = _zarr_array(spark, path)[1]["shape"]
        return tuple([1] * (3 - len(shape)) + shape[-3:])
    got = headers(spark, path).agg(F.sum("dz"), F.max("height"), F.max("width")).first()
    return tuple(int(x or 0) for x in got)


def check(headers_: DataFrame) -> None:
    """One shape and one type for all files, else ValueError."""
    got = headers_.agg(F.count_distinct("height", "width").alias("shapes"), F.count_distinct("dtype").alias("types")).first()
    if got.shapes > 1 or got.types > 1:
        raise ValueError(f"the files of a volume must agree: {got.shapes} shapes, {got.types} types")


def _order() -> list[Column]:
    file = F.col("file")
    number = F.regexp_extract(file, ranges.NUMBERED, 2)
    return [F.when(file.rlike(ranges.NUMBERED), F.regexp_extract(file, ranges.NUMBERED, 1)).otherwise(file), F.char_length(number), number]


def _stack(spark: SparkSession, path: str, checked: bool, kinds: tuple[bool, bool, int] | None = None) -> DataFrame:
    """path, lo, hi of the files of a volume: where each lies along z, from headers; a row for each file."""
    h = headers(spark, path, kinds)
    if checked:
        check(h)
    return tiling.stitched_ranges(h, *_order()).select(F.col("file").alias("path"), "lo", "hi")


def read_slices(spark: SparkSession, path: str, checked: bool = True, z: tuple[int, int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """z, y0, x0, height, width, data of a file, a directory of files in the order of their names (and of the sinks' numbers in them), or
    a Zarr store (there a row for each slice of a chunk).

    Places come from the headers; each file is read once, by several tasks where it is large. Folders of more than ``ranges.PLANNED``
    files are listed and put in order by tasks, in a table below the shared folder. With ranges of z and y only the bytes (or
    the files or chunks) that they touch are read; rows of a Zarr store may reach beyond those of y and x.
    """
    if paths.resolve(path) == "zarr":
        at = _zarr(spark, path, z).withColumn("lo", F.lit(0))
    else:
        kinds = _kinds(spark, path)
        if _ranged(path, kinds):
            box = {a: f"{max(0, r[0])}:{max(0, r[1])}" for a, r in (("z", z), ("y", y), ("x", x)) if r is not None}
            if kinds[2] > ranges.PLANNED:
                if ranges.shared(spark):
                    index, box["places"] = ranges.indexed(spark, path, kinds[2])
                else:
                    warnings.warn(f"the driver plans {kinds[2]} files: no folder is known that all executors share and Arrow reaches", stacklevel=2)
            if checked and paths.resolve(path) == "directory":
                check(index if "places" in box else headers(spark, path, kinds))
            found = ranges.files(spark).options(checked=str(checked).lower(), **box).load(path)
            return found.select("z", "y0", "x0", "height", "width", "data")
        places = _stack(spark, path, checked, kinds)
        if z is not None:
            places = places.where((F.col("lo") < z[1]) & (F.col("hi") > z[0]))
            needed = [r.path for r in places.select("path").toLocalIterator()]  # names that the reader lists anyway
            if not needed:
                return spark.createDataFrame([], predict.SLICES)
        at = slices(spark, path if z is None else needed, kinds if z is None else None).join(F.broadcast(places.drop("hi")), "path")
    out = at.select((F.col("z") + F.col("lo")).alias("z"), "y0", "x0", "height", "width", "data")
    return out if z is None else out.where((F.col("z") >= max(0, z[0])) & (F.col("z") < z[1]))


def read_volume(spark: SparkSession, path: str, checked: bool = True, z: tuple[int, int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """z, y, x, v of read_slices(), cut to the box."""
    out = predict.to_voxels(read_slices(spark, path, checked, z, y, x))
    for name, r in (("y", y), ("x", x)):
        out = out if r is None else out.where((F.col(name) >= r[0]) & (F.col(name) < r[1]))
    return out


def slice_names(spark: SparkSession, path: str) -> DataFrame:
    """z, name of the files of a stack that hold one slice each."""
    return _stack(spark, path, True).where("hi = lo + 1").select(F.col("lo").alias("z"), paths.file_name(F.col("path")).alias("name"))


# --- sinks


def save_slices(rows: DataFrame, folder: str, layout: str = "slices", suffix: str = ".tif", dtype: str = "float32", name: str = "volume", shape: tuple[int, int, int] | None = None, mode: str = "append") -> None:
    """Whole slices (z, height, width, data; perhaps name) to files, by the sink of ``ranges``: all of them appear, or none.

    Slices go as they are from reader to file. ``mode`` overwrite removes the folder's other files when the new ones are there.
    """
    keep = [c for c in ("z", "height", "width", "data", "name") if c in rows.columns]
    ranges.registered(rows.sparkSession)
    to = rows.select(*keep).write.format("volume_files").mode(mode).options(layout=layout, suffix=suffix, dtype=dtype, name=name)
    (to if shape is None else to.option("shape", ",".join(map(str, shape)))).save(folder)


def put(path: str, data: bytes) -> int:
    """Whole or not at all: a task that runs again replaces the file with the same one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, path)
    return len(data)


def _cube(z: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray, dtype: str, lo: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    at = [a - o for a, o in zip((z, y, x), lo, strict=True)]
    out = np.zeros([int(a.max()) + 1 for a in at], dtype)
    out[tuple(at)] = v.astype(dtype)
    return out


WRITTEN = "file string, bytes long"
_CELLS = ["z", "y", "x", "v"]


def write_slices(vox: DataFrame, folder: str, name: str = "volume", suffix: str = ".tif", dtype: str = "float32") -> DataFrame:
    """One file for each slice, ``{name}_{z:05d}{suffix}``, in a folder that all executors share: file, bytes. Runs when read."""

    def work(n: int, z: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> list[tuple]:
        path = f"{folder}/{name}_{n:05d}{suffix}"
        return [(path, put(path, codecs.encode(_cube(z, y, x, v, dtype, (n, 0, 0)), suffix)))]

    return worked(vox, [F.col("z")], _CELLS, work, WRITTEN)


def write_named(vox: DataFrame, folder: str, names: DataFrame, dtype: str = "float32") -> DataFrame:
    """One file for each slice under the names (z, name) of its source files."""

    def work(n: int, name: str, z: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> list[tuple]:
        suffix = ".nii.gz" if name.endswith(".nii.gz") else os.path.splitext(name)[1].lower()
        path = f"{folder}/{name}"
        return [(path, put(path, codecs.encode(_cube(z, y, x, v, dtype, (n, 0, 0)), suffix)))]

    rows = vox.select(*_CELLS).join(names.select("z", F.col("name").alias("name_")), "z")
    return worked(rows, [F.col("z"), F.col("name_")], _CELLS, work, WRITTEN)


def write_chunks(vox: DataFrame, folder: str, depth: int, chunk: int, name: str = "volume", suffix: str = ".tif", dtype: str = "float32") -> DataFrame:
    """One file for each run of slices, ``{name}_z{z0}-{z1}{suffix}``; a chunk is what a task holds."""

    def work(k: int, z: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> list[tuple]:
        z0 = k * chunk
        path = f"{folder}/{name}_z{z0}-{min(depth, z0 + chunk)}{suffix}"
        return [(path, put(path, codecs.encode(_cube(z, y, x, v, dtype, (z0, 0, 0)), suffix)))]

    return worked(vox, [F.expr(f"z DIV {chunk}")], _CELLS, work, WRITTEN)


def write_single(vox: DataFrame, folder: str, shape: tuple[int, int, int], name: str = "volume", suffix: str = ".tif", dtype: str = "float32") -> DataFrame:
    """One file for the whole volume, ``{name}{suffix}``: slices are encoded where they are and then written in order by one task,
    which holds one slice at a time."""

    def page(n: int, z: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> list[tuple]:
        full = np.zeros((1, *shape[1:]), dtype)
        full[0, y, x] = v.astype(dtype)
        return [(n, full.tobytes())]

    pages = worked(vox, [F.col("z")], _CELLS, page, "z long, page binary").repartition(1).sortWithinPartitions("z")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{name}{suffix}"
        os.makedirs(folder, exist_ok=True)
        own, done = f"{path}.{os.getpid()}", 0
        with open(own, "wb") as f:
            sink = codecs.Pages(f, shape, dtype, suffix)
            for b in batches:
                for z, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    while done < z:  # slices without voxels
                        sink.add(bytes(len(data.as_buffer())))
                        done += 1
                    sink.add(data.as_py())
                    done += 1
            while done < shape[0]:
                sink.add(bytes(shape[1] * shape[2] * np.dtype(dtype).itemsize))
                done += 1
            sink.close()
        os.replace(own, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([os.path.getsize(path)], pa.int64())], ["file", "bytes"])

    return pages.mapInArrow(write, WRITTEN)


def write_zarr(vox: DataFrame, folder: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], dtype: str = "float32", compressor: str = "blosc") -> DataFrame:
    """A Zarr array: its metadata first, then one file for each chunk that holds a voxel."""
    put(f"{folder}/.zarray", codecs.zarr_metadata(shape, chunks, dtype, compressor).encode())

    def work(a: int, b: int, c: int, z: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> list[tuple]:
        path = f"{folder}/{a}.{b}.{c}"
        lo = tuple(i * n for i, n in zip((a, b, c), chunks, strict=True))
        return [(path, put(path, codecs.write_chunk(_cube(z, y, x, v, np.dtype(dtype).str, lo), chunks, compressor)))]

    return worked(vox, [F.expr(f"{c} DIV {n}") for c, n in zip("zyx", chunks, strict=True)], _CELLS, work, WRITTEN)


def write_ome_zarr(vox: DataFrame, folder: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], levels: int, factor: int = 2, dtype: str = "float32") -> DataFrame:
    """A pyramid as a Zarr group with its multiscales block: one array for each level."""
    shapes = resample.levels(shape, levels, factor)
    put(f"{folder}/.zgroup", b'{"zarr_format": 2}')
    put(f"{folder}/.zattrs", ('{"multiscales": ' + resample.ome_metadata(len(shapes), factor) + "}").encode())
    out, now = None, vox.select("z", "y", "x", "v")
    for i, s in enumerate(shapes):
        if i:
            now = cut(resample.nearest(now, shapes[i - 1], s))  # the next level is made from this one, not from the volume
        files = write_zarr(now, f"{folder}/{i}", s, chunks, dtype)
        out = files if out is None else out.union(files)
    return out


def write_blocks(vox: DataFrame, path: str, block: int = 64, mode: str = "overwrite") -> None:
    """Parquet in folders of z blocks; a region written again replaces only its own blocks. The scan of a box reads its blocks only."""
    rows = vox.withColumn("bz", F.expr(f"z DIV {block}"))
    rows.repartition("bz").sortWithinPartitions("z", "y", "x").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bz").parquet(path)


def read_blocks(spark: SparkSession, path: str, z: tuple[int, int] | None = None, block: int = 64) -> DataFrame:
    """z, y, x, v; with a range of z only the folders of its blocks are listed for reading."""
    rows = spark.read.parquet(path)
    if z is not None:
        rows = rows.where((F.col("bz") >= z[0] // block) & (F.col("bz") <= (z[1] - 1) // block) & (F.col("z") >= z[0]) & (F.col("z") < z[1]))
    return rows.select("z", "y", "x", "v")


def morton(block: int, bits: int = 20) -> Column:
    """Number of a voxel's block along a curve that visits near blocks one after the other: the bits of its three places in turn."""
    places = [F.expr(f"{c} DIV {block}").cast("long") for c in "zyx"]
    one = [F.shiftleft(F.shiftright(p, b).bitwiseAND(F.lit(1)), 3 * b + 2 - i) for b in range(bits) for i, p in enumerate(places)]
    return functools.reduce(Column.bitwiseOR, one)


def write_cells(vox: DataFrame, path: str, block: int = 32, blocks_per_file: int = 8, mode: str = "overwrite") -> None:
    """Parquet in the order of ``morton``: each file holds a few blocks near each other, so its least and greatest z, y and x tell a
    box whether to read it. Ranges of the curve are dealt to tasks, whatever the volume's shape."""
    rows = vox.withColumn("block", morton(block))
    sorted_ = rows.repartitionByRange("block", "z", "y", "x").sortWithinPartitions("block", "z", "y", "x")
    sorted_.write.mode(mode).option("maxRecordsPerFile", blocks_per_file * block**3).parquet(path)


def read_cells(spark: SparkSession, path: str, z: tuple[int, int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """z, y, x, v of a box: comparisons that the scan holds against each file's statistics in all three axes."""
    every = (0, 1 << 40)
    return tiling.box(spark.read.parquet(path), z or every, y or every, x or every).select("z", "y", "x", "v")
