"""Volumes in files as a Spark data source that reads ranges of bytes.

``volume_headers`` gives a row for each file from a few kilobytes of it. ``volume_files`` plans from such headers: its partitions are
runs of slices inside the files, of about ``bytes`` bytes each, so one file of any size is read by many tasks and many small files by
one. The headers are read on the driver, but those of large folders by tasks: ``indexed`` writes a table of the files in order, and the
option ``places`` (a row for each part of that table) is all that the plan then holds. Options ``z``, ``y`` and ``x`` (``lo:hi``) cut
a box: files, pages, strips and rows outside are not read; filters on the column z do the same for z in sessions that push filters
into Python sources (others need ``files`` or the format ``volume_files_unfiltered``). Whole are read only what has no inner places:
PNG, and ``.nii.gz`` as a stream, slice by slice.

Files are reached by Arrow's file systems (local paths, hdfs, s3, gs).
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tessavox.operators import lineage
from tessavox.sources import codecs, sink
from tessavox.sources.places import opened

SLICES = "path string, z long, y0 long, x0 long, height long, width long, dtype string, data array<double>"
HEADERS = "file string, dz long, height long, width long, dtype string"
#: Headers with the bytes of the slices and what a volume's files are ordered by.
INDEX = HEADERS + ", bytes long, head string, digits long, number string"
#: Bytes of a partition; bytes that are read at once for a header; threads that read headers for a plan; files of a task of headers.
BYTES, HEAD, THREADS, FILES = 64 << 20, 1024, 16, 256
#: Files of a folder whose headers the driver reads for a plan, and files of a part of the index of a larger folder.
PLANNED = 4096
SUFFIXES = (".tif", ".tiff", ".nii", ".nii.gz", ".gz", ".png")
#: Names as the sinks give them: ``_z{z0}-{z1}`` or ``_{z:05d}``; these numbers count as such, since they outgrow their digits.
NUMBERED = r"^(.*_(?:z(?=[0-9]+-[0-9]+\.)|(?=[0-9]{5,}\.)))0*([0-9]+)[^/]*$"


def reachable(path: str) -> bool:
    """Whether Arrow has a file system for the path."""
    scheme = re.match(r"^([a-z0-9+.-]+):", path)
    return scheme is None or scheme[1] in ("file", "hdfs", "s3", "gs")


def suffix(path: str) -> str:
    low = path.lower()
    return ".nii.gz" if low.endswith(".nii.gz") else next((s for s in SUFFIXES if low.endswith(s)), "")


def place(path: str) -> tuple:
    """The order of a volume's files: by name, the sinks' numbers as numbers."""
    m = re.match(NUMBERED, path)
    return (m[1], len(m[2]), m[2]) if m else (path, 0, "")


class Bytes:
    """Reads of ranges of one file; counts them."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.read, self.held, self.at = file, 0, b"", 0

    def get(self, at: int, n: int) -> bytes:
        self.read += n
        return self.file.read_at(n, at)

    def near(self, at: int, n: int) -> bytes:
        """Like get, from what was read last where it lies there."""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.held, self.at = self.get(at, max(n, HEAD)), at
        return self.held[at - self.at : at - self.at + n]


@dataclass
class Layout:
    """Where a file's slices lie: pages of strips of ``rows`` rows, or whole (no places inside)."""

    height: int
    width: int
    dtype: str
    pages: list[tuple[list[int], list[int]]] = field(default_factory=list)
    depth: int = 0
    rows: int = 0
    compression: int = 1
    predictor: int = 1
    start: int = -1
    scale: tuple[float, float] = (1.0, 0.0)

    def bytes_of(self, page: int) -> int:
        return sum(self.pages[page][1]) if self.pages else self.height * self.width * np.dtype(self.dtype).itemsize

    @property
    def total(self) -> int:
        """Bytes of all slices."""
        return sum(self.bytes_of(k) for k in range(self.depth))

    @property
    def inner(self) -> bool:
        return bool(self.pages) or self.start >= 0

    @property
    def shown(self) -> str:
        return "float64" if self.scale != (1.0, 0.0) else np.dtype(self.dtype).name


def _tiff(b: Bytes) -> Layout:
    """Places of the pages of the largest height and width, classic or of 8-byte places."""
    first = b.near(0, 16)
    e = {b"II": "<", b"MM": ">"}[first[:2]]
    big = struct.unpack(e + "H", first[2:4])[0] == 43
    at = struct.unpack(e + "Q", first[8:16])[0] if big else struct.unpack(e + "I", first[4:8])[0]
    head, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    kinds = {1: "u1", 3: "u2", 4: "u4", 16: "u8"}
    found: list[tuple[tuple, tuple[list[int], list[int]]]] = []
    while at:
        n = struct.unpack(e + head, b.near(at, struct.calcsize(head)))[0]
        at += struct.calcsize(head)
        raw = b.near(at, n * entry + inline)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind = struct.unpack(e + "HH", raw[i * entry : i * entry + 4])
            count = struct.unpack(e + ("Q" if big else "I"), raw[i * entry + 4 : i * entry + 4 + inline])[0]
            value = raw[(i + 1) * entry - inline : (i + 1) * entry]
            if kind in kinds:
                size = count * np.dtype(kinds[kind]).itemsize
                if size > inline:
                    value = b.near(struct.unpack(e + ("Q" if big else "I"), value)[0], size)
                tags[tag] = np.frombuffer(value[:size], e + kinds[kind]).tolist()
        if tags.get(277, [1])[0] != 1:
            raise ValueError("TIFF pages with several samples aren't supported")
        dtype = e + {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(tags.get(258, [8])[0] // 8)
        height = tags[257][0]
        found.append(((height, tags[256][0], dtype, min(height, tags.get(278, [height])[0]), tags.get(259, [1])[0], tags.get(317, [1])[0]), (tags[273], tags[279])))
        at = struct.unpack(e + ("Q" if big else "I"), raw[n * entry : n * entry + inline])[0]
    if not found:
        raise ValueError("a TIFF file without pages")
    best = max((f[0] for f in found), key=lambda k: k[0] * k[1])
    pages = [strips for k, strips in found if k[:2] == best[:2]]
    if any(k != best for k, _ in found if k[:2] == best[:2]):
        raise ValueError("the pages of a TIFF file must agree in type, strips and compression")
    return Layout(best[0], best[1], best[2], pages, len(pages), best[3], best[4], best[5])


def _nifti(b: Bytes) -> Layout:
    first = b.near(0, 352)
    packed = first[:2] == b"\x1f\x8b"
    e, kind, (z, y, x), offset, slope, shift = codecs._nifti_head(zlib.decompressobj(31).decompress(b.near(0, HEAD), 352) if packed else first)
    scale = (1.0, 0.0) if slope in (0, 1) and shift == 0 else (slope, shift)
    return Layout(y, x, e + kind, depth=z, start=-1 if packed else offset, scale=scale)


def layout(path: str, b: Bytes | None = None) -> Layout:
    """From a few kilobytes of the file (for each page, in TIFF)."""
    if b is None:
        system, at = opened(path)
        with system.open_input_file(at) as f:
            return layout(path, Bytes(f))
    kind = suffix(path)
    if kind in (".tif", ".tiff"):
        return _tiff(b)
    if kind in (".nii", ".nii.gz", ".gz"):
        return _nifti(b)
    width, height, bits = struct.unpack(">IIB", b.near(0, 25)[16:25])
    return Layout(height, width, f"uint{bits}", depth=1)


def _entries(system: fs.FileSystem, at: str) -> Iterator[tuple[str, bool]]:
    """Paths of what lies in a folder, and whether they are folders; on local file systems none is held."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                if e.is_dir() or e.is_file():
                    yield f"{at.rstrip('/')}/{e.name}", e.is_dir()
    else:
        for i in system.get_file_info(fs.FileSelector(at)):
            if i.type in (fs.FileType.Directory, fs.FileType.File):
                yield i.path, not i.is_file


def walked(system: fs.FileSystem, root: str, folders: bool = False) -> Iterator[str]:
    """Files below a folder, those whose names or folders begin with _ or . left out; or the folder itself and all folders below it."""
    todo = [root]
    while todo:
        at = todo.pop()
        if folders:
            yield at
        for p, inner in _entries(system, at):
            if inner and (folders or not re.search(r"/[_.][^/]*$", p)):
                todo.append(p)
            elif not inner and not folders and not re.search(r"/[_.][^/]*$", p):
                yield p


def found(path: str) -> Iterator[str]:
    """Readable files below a path and JPEG files, or the file itself, in no order, as the path is given (with its scheme)."""
    system, root = opened(path)
    if system.get_file_info(root).is_file:
        yield path
        return
    head = path[: len(path) - len(root)] if path.endswith(root) else ""
    yield from (head + p for p in walked(system, root) if suffix(p) or p.lower().endswith(".jpg"))


def listed(path: str) -> list[str]:
    """Readable files below a path, or the file itself, in a volume's order, as the path is given (with its scheme)."""
    return sorted((p for p in found(path) if p == path or suffix(p)), key=place)


def _in_batches(rows: Iterator[tuple], schema: str, size: int = 4096) -> Iterator[pa.RecordBatch]:
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in fields])
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds.types, strict=True)], schema=kinds)


def names(spark: SparkSession, path: str) -> DataFrame:
    """file of all that found() gives, listed by a task: no list of them is held anywhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                yield from _in_batches(((f,) for f in found(p)), "file string")

    return spark.range(0, 1, 1, 1).select(F.lit(path).alias("path")).mapInArrow(run, "file string")


def folders(spark: SparkSession, path: str) -> DataFrame:
    """path of a folder of a mounted file system (with the scheme file, or none) and of all below it, listed by a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                plain = re.sub("^file:/+", "/", p)
                yield from _in_batches(((p[: len(p) - len(plain)] + f,) for f in walked(fs.LocalFileSystem(), plain, True)), "path string")

    return spark.range(0, 1, 1, 1).select(F.lit(path).alias("path")).mapInArrow(run, "path string")


def headed(spark: SparkSession, path: str, count: int) -> DataFrame:
    """INDEX of the readable files below a path, about ``count``, whose headers are read by tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((p, layout(p)) for p in b.column(0).to_pylist() if p == path or suffix(p))
            yield from _in_batches(((p, f.depth, f.height, f.width, f.shown, f.total, *place(p)) for p, f in rows), INDEX)

    tasks = max(1, -(-count // PLANNED), min(-(-count // FILES), spark.sparkContext.defaultParallelism))
    return names(spark, path).repartition(tasks, "file").mapInArrow(run, INDEX)


def shared(spark: SparkSession) -> bool:
    """Whether there is a folder that all executors share and Arrow reaches."""
    try:
        return reachable(lineage.shared_folder(spark, "places"))
    except ValueError:
        return False


def indexed(spark: SparkSession, path: str, count: int) -> tuple[DataFrame, str]:
    """INDEX of a large folder, written in a volume's order below the folder that all executors share, and the option ``places`` for it."""
    to, order = lineage.shared_folder(spark, "places"), ["head", "digits", "number", "file"]
    parts = max(1, -(-count // PLANNED))
    cut = headed(spark, path, count).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut.withColumn("part", F.spark_partition_id()).write.parquet(to)
    table = spark.read.parquet(to)
    per_part = table.groupBy("part", F.col("_metadata.file_name").alias("name")).agg(F.sum("dz").alias("dz"), F.sum("bytes").alias("bytes"))
    places, z = [], 0
    for r in sorted(per_part.collect()):  # a row for each part
        places.append((f"{to}/{r.name}", z, z + r.dz, r.bytes))
        z += r.dz
    return table, json.dumps(places)


def span(text: str | None) -> tuple[int, int]:
    lo, _, hi = (text or ":").partition(":")
    return max(0, int(lo or 0)), int(hi) if hi else 1 << 60


@dataclass
class Run:
    """Slices first..last of a file, which begin at z of the volume."""

    path: str
    layout: Layout | None
    z: int
    first: int
    last: int


class Runs(InputPartition):
    def __init__(self, runs: list[Run]):
        super().__init__(None)
        self.runs = runs


class Places(InputPartition):
    """The slices lo..hi of the volume, whose files stand in a part of an index that begins at z."""

    def __init__(self, part: str, z: int, lo: int, hi: int):
        super().__init__(None)
        self.part, self.z, self.lo, self.hi = part, z, lo, hi


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.paths = listed(options["path"])

    def partitions(self) -> list[Files]:
        return [Files(self.paths[i : i + FILES]) for i in range(0, len(self.paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for p in partition.paths:
            f = layout(p)
            yield p, f.depth, f.height, f.width, f.shown


class SliceReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.checked = options["path"], int(options.get("bytes", BYTES)), options.get("checked", "true") == "true"
        self.z, self.y, self.x = (span(options.get(a)) for a in "zyx")
        self.places = options.get("places")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("z",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                lo, hi = self.z
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    lo = max(lo, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    hi = min(hi, f.value + (not isinstance(f, LessThan)))
                self.z = lo, hi
            else:
                yield f

    def _planned(self) -> Iterator[Places]:
        """Parts of the index, cut where they hold more than a partition's bytes."""
        for part, start, stop, size in json.loads(self.places):
            n = max(1, min(stop - start, -(-size // self.size)))
            for k in range(n):
                lo, hi = (start + (stop - start) * i // n for i in (k, k + 1))
                if max(lo, self.z[0]) < min(hi, self.z[1]):
                    yield Places(part, start, max(lo, self.z[0]), min(hi, self.z[1]))

    def partitions(self) -> list[Runs | Places]:
        if self.places is not None:
            return list(self._planned()) or [Runs([])]
        paths = listed(self.path)
        with ThreadPoolExecutor(THREADS) as pool:
            layouts = list(pool.map(layout, paths))
        if self.checked and (len({(f.height, f.width) for f in layouts}) > 1 or len({f.shown for f in layouts}) > 1):
            raise ValueError(f"the files of a volume must agree: {len({(f.height, f.width) for f in layouts})} shapes, {len({f.shown for f in layouts})} types")
        out: list[list[Run]] = [[]]
        z = held = 0
        for p, f in zip(paths, layouts, strict=True):
            first, last = max(0, self.z[0] - z), min(f.depth, self.z[1] - z)
            while first < last:
                if held >= self.size:
                    out.append([])
                    held = 0
                at = first
                while at < last and (held < self.size or at == first or not f.inner):
                    held += f.bytes_of(at)
                    at += 1
                out[-1].append(Run(p, f, z + first, first, at))
                first = at
            z += f.depth
        return [Runs(r) for r in out]

    def read(self, partition: Runs | Places) -> Iterator[pa.RecordBatch]:
        for run in partition.runs if isinstance(partition, Runs) else self._placed(partition):
            system, at = opened(run.path)
            if run.layout is None or run.layout.inner:
                with system.open_input_file(at) as f:
                    b = Bytes(f)
                    run.layout = run.layout or layout(run.path, b)
                    if run.layout.inner:
                        yield from self._ranges(run, b)
                        continue
            if suffix(run.path) == ".png":
                with system.open_input_stream(at, compression=None) as f:
                    yield from self._cut(run, 0, codecs.read_png(f.read())[0], 0)
            else:
                with system.open_input_stream(at, compression="gzip") as f:
                    f.read(self._start(f))
                    n = run.layout.height * run.layout.width * np.dtype(run.layout.dtype).itemsize
                    for k in range(run.last):
                        data = f.read(n)
                        if k >= run.first:
                            yield from self._cut(run, k, np.frombuffer(data, run.layout.dtype).reshape(run.layout.height, run.layout.width), 0)

    @staticmethod
    def _placed(partition: Places) -> Iterator[Run]:
        """Runs of a part of the index; their layouts are read with the files."""
        system, at = opened(partition.part)
        z = partition.z
        with system.open_input_file(at) as f:
            for b in pq.ParquetFile(f).iter_batches(4096, columns=["file", "dz"]):
                for path, dz in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    first, last = max(0, partition.lo - z), min(dz, partition.hi - z)
                    if first < last:
                        yield Run(path, None, z + first, first, last)
                    z += dz

    @staticmethod
    def _start(f) -> int:
        """What lies between a NIfTI header and its values; reads the header."""
        return codecs._nifti_head(f.read(352))[3] - 352

    def _ranges(self, run: Run, b: Bytes) -> Iterator[pa.RecordBatch]:
        f = run.layout
        kind = np.dtype(f.dtype)
        top, bottom = self.y[0], min(f.height, self.y[1])
        if top >= bottom:
            return
        line = f.width * kind.itemsize
        for k in range(run.first, run.last):
            if f.start >= 0:
                data, row = b.get(f.start + (k * f.height + top) * line, (bottom - top) * line), top
            else:
                offsets, counts = f.pages[k]
                wanted = range(top // f.rows, min(len(offsets), -(-bottom // f.rows)))
                row = wanted[0] * f.rows
                if f.compression == 1:  # only the rows of the box
                    parts, row = [], top
                    for s in wanted:
                        a, z = max(top, s * f.rows), min(bottom, (s + 1) * f.rows)
                        parts.append(b.get(offsets[s] + (a - s * f.rows) * line, (z - a) * line))
                else:
                    parts = [codecs._unpacked(b.get(offsets[s], counts[s]), f.compression) for s in wanted]
                data = b"".join(parts)
            page = np.frombuffer(data, kind, len(data) // line * f.width).reshape(-1, f.width)
            yield from self._cut(run, k, np.cumsum(page, axis=1, dtype=kind) if f.predictor == 2 else page, row)

    def _cut(self, run: Run, k: int, page: np.ndarray, row: int) -> Iterator[pa.RecordBatch]:
        """The box's part of a slice of which rows from ``row`` on were read."""
        f = run.layout
        top, bottom = self.y[0], min(f.height, self.y[1])
        left, right = self.x[0], min(f.width, self.x[1])
        if top >= bottom or left >= right:
            return
        page = page[top - row : bottom - row, left:right].astype(np.float64)
        if f.scale != (1.0, 0.0):
            page = page * f.scale[0] + f.scale[1]
        flat = pa.array(np.ascontiguousarray(page).ravel())
        data = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        one = [pa.array([v], pa.int64()) for v in (run.z + k - run.first, top, left, bottom - top, right - left)]
        yield pa.RecordBatch.from_arrays([pa.array([run.path]), *one, pa.array([f.shown]), data], [c.split(" ")[0] for c in SLICES.split(", ")])


class UnfilteredReader(SliceReader):
    """For sessions that push no filters, which refuse a reader that takes some; Spark filters what is read."""

    pushFilters = DataSourceReader.pushFilters


class VolumeHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options)


class VolumeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_files"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema: StructType) -> SliceReader:
        return SliceReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> sink.SliceWriter:
        return sink.SliceWriter(self.options, schema, overwrite)


class UnfilteredFiles(VolumeFiles):
    @classmethod
    def name(cls) -> str:
        return "volume_files_unfiltered"

    def reader(self, schema: StructType) -> UnfilteredReader:
        return UnfilteredReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with all formats."""
    spark.createDataFrame([], "file string")  # makes it the active one, in which Spark looks whether a format is there
    for source in (VolumeHeaders, VolumeFiles, UnfilteredFiles):
        try:
            spark.dataSource.register(source)
        except AnalysisException as e:
            if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
                raise
    return spark


def files(spark: SparkSession) -> DataFrameReader:
    """A reader of ``volume_files``, which takes filters where the session pushes them."""
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    return registered(spark).read.format("volume_files" if pushed else "volume_files_unfiltered")
