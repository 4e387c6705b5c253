"""Prediction as an opaque function over batches of patches, and the whole path from slices to a mask.

Volumes come and go as rows of slices: z, y0, x0, height, width, data (an array of values). Pieces of slices meet in their
patches, predictions leave as pieces for bands of rows of the output; both shuffles carry bytes, not voxels. What a
task holds is a few patches, or one band with the chunks over it.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavox.functions import intensity
from tessavox.operators import networks, normalize, pad
from tessavox.operators.tiling import starts

Model = Callable[[np.ndarray], np.ndarray]
#: Models by name: (n, depth, height, width) -> logits, (n, height, width) for patches of depth 1. Networks register here where
#: their libraries exist.
MODELS: dict[str, Callable[..., Model]] = {}
SLICES = "z long, y0 long, x0 long, height long, width long, data array<double>"
_PIECE = "z long, y long, x long, h long, w long, bytes binary"


def register(name: str):
    def add(make: Callable[..., Model]) -> Callable[..., Model]:
        MODELS[name] = make
        return make

    return add


@register("linear")
def linear(weight: float = 1.0, bias: float = 0.0) -> Model:
    """A voxelwise linear model, for tests."""
    return lambda batch: weight * batch + bias


@register("convolution")
def convolution(**parameters) -> Model:
    """A small network, as training leaves it."""
    network = networks.Convolution(**parameters)
    return lambda batch: network.forward(batch)[0]


def to_slices(vox: DataFrame) -> DataFrame:
    """SLICES of a volume in long form; a slice bounds a row."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    rows = vox.groupBy("z").agg(cells.alias("c"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    zero = F.lit(0).cast("long")
    return rows.select("z", zero.alias("y0"), zero.alias("x0"), "height", "width", F.transform("c", lambda c: c["v"]).alias("data"))


def to_voxels(slices: DataFrame) -> DataFrame:
    """z, y, x, v of SLICES."""
    rows = slices.select("z", "y0", "x0", "width", F.posexplode("data").alias("i", "v"))
    return rows.select("z", (F.col("y0") + F.expr("i DIV width")).alias("y"), (F.col("x0") + F.expr("i % width")).alias("x"), "v")


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _over(places: list[int], size: int, lo: int, hi: int) -> list[int]:
    """The starts (in order) of tiles that touch lo..hi."""
    return places[bisect_right(places, lo - size) : bisect_left(places, hi)]


def patches(slices: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], overlap: tuple[int, int, int]) -> DataFrame:
    """pz, py, px, pieces: the slices' pieces in each patch of the grid; tiles at an end are moved inward."""
    plan = [starts(n, s, o) for n, s, o in zip(shape, size, overlap, strict=True)]
    keyed = "pz long, py long, px long, " + _PIECE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                z, y0, x0, h, w = (b.column(k)[i].as_py() for k in range(5))
                a = np.asarray(b.column(5)[i].values, np.float64).reshape(h, w)
                out = []
                for pz in _over(plan[0], size[0], z, z + 1):
                    for py in _over(plan[1], size[1], y0, y0 + h):
                        for px in _over(plan[2], size[2], x0, x0 + w):
                            y, x = max(y0, py), max(x0, px)
                            piece = a[y - y0 : py + size[1] - y0, x - x0 : px + size[2] - x0]
                            out.append((pz, py, px, z, y, x, *piece.shape, piece.tobytes()))
                if out:
                    yield _table(out, keyed)

    rows = slices.select("z", "y0", "x0", "height", "width", "data").mapInArrow(cut, keyed)
    return rows.groupBy("pz", "py", "px").agg(F.collect_list(F.struct("z", "y", "x", "h", "w", "bytes")).alias("pieces"))


def _placed(pieces: pa.StructArray, lo: tuple[int, int, int], shape: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for z, y, x, h, w, data in zip(*[pieces.field(k).to_pylist() for k in range(6)], strict=True):
        out[z - lo[0], y - lo[1] : y - lo[1] + h, x - lo[2] : x - lo[2] + w] = np.frombuffer(data).reshape(h, w)
    return out


def resized_back(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Order 1 between mirrored edges, smoothed first along axes that shrink; centres are matched."""
    for axis, n in enumerate(shape):
        m = a.shape[axis]
        if m == n:
            continue
        a = np.moveaxis(a, axis, -1)
        mirror = lambda i, m=m: np.abs((i + m - 1) % max(1, 2 * m - 2) - (m - 1)) if m > 1 else np.zeros_like(i)
        if m > n:
            sigma = (m / n - 1) / 2
            reach = int(4 * sigma + 0.5)
            kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
            around = mirror(np.arange(m)[:, None] + np.arange(-reach, reach + 1))
            a = (a[..., around] * (kernel / kernel.sum())).sum(-1)
        at = (np.arange(n) + 0.5) * m / n - 0.5
        at = np.abs(at)
        at = np.where(at > m - 1, 2 * (m - 1) - at, at)
        low = np.clip(np.floor(at).astype(int), 0, m - 1)
        share = at - low
        a = a[..., low] * (1 - share) + a[..., np.minimum(low + 1, m - 1)] * share
        a = np.moveaxis(a, -1, axis)
    return a


def _run(model: Model, batch: np.ndarray) -> np.ndarray:
    """Patches of depth 1 are flat for the model; what comes back in another size is resized."""
    flat = batch.shape[1] == 1
    out = np.asarray(model(batch[:, 0] if flat else batch), np.float64)
    out = out[:, None] if flat else out
    return out if out.shape == batch.shape else np.stack([resized_back(a, batch.shape[1:]) for a in out])


def whole(cut: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], pad_mode: str = "reflect", fill: float = 0.0) -> DataFrame:
    """pz, py, px, data: each patch (of patches()) as one flat array, padded to its size as for prediction where the volume is smaller."""
    real = tuple(min(a, b) for a, b in zip(shape, size, strict=True))
    widths = [pad.widths(n, s, i == 0) for i, (n, s) in enumerate(zip(real, size, strict=True))]
    extra = {"constant_values": fill} if pad_mode == "constant" else {}
    schema = "pz long, py long, px long, data array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = tuple(b.column(k)[i].as_py() for k in range(3))
                yield _table([(*at, np.pad(_placed(b.column(3)[i].values, at, real), widths, pad_mode, **extra).ravel())], schema)

    return cut.mapInArrow(run, schema)


def predicted(cut: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], model: Model, batch: int = 8, band: int = 64, pad_mode: str = "reflect", fill: float = 0.0) -> DataFrame:
    """band, pz, z, y, x, h, w, bytes: the model's logits for patches (of patches()), cut for bands of rows.

    A volume smaller than a patch is padded, along z on both sides, along y and x at the end, and the logits are cut back.
    """
    real = tuple(min(a, b) for a, b in zip(shape, size, strict=True))
    widths = [pad.widths(n, s, i == 0) for i, (n, s) in enumerate(zip(real, size, strict=True))]
    extra = {"constant_values": fill} if pad_mode == "constant" else {}
    keyed = "band long, pz long, " + _PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                some = b.slice(i, batch)
                at = list(zip(*[some.column(k).to_pylist() for k in range(3)], strict=True))
                stack = np.stack([np.pad(_placed(some.column(3)[k].values, p, real), widths, pad_mode, **extra) for k, p in enumerate(at)])
                out = _run(model, stack)[(slice(None), *(slice(w[0], w[0] + n) for w, n in zip(widths, real, strict=True)))]
                for (pz, py, px), logits in zip(at, out, strict=True):
                    rows = []
                    for z, page in enumerate(logits):
                        y = py
                        while y < py + real[1]:
                            stop = min(py + real[1], (y // band + 1) * band)
                            rows.append((y // band, pz, pz + z, y, px, stop - y, real[2], page[y - py : stop - py].tobytes()))
                            y = stop
                    yield _table(rows, keyed)

    return cut.mapInArrow(run, keyed)


def stitched(pieces: DataFrame, shape: tuple[int, int, int], finish: Callable[[np.ndarray], np.ndarray], band: int = 64) -> DataFrame:
    """SLICES of bands of rows: the mean over the patches of a chunk along z, then acc = (acc + next) / 2 over the chunks in turn, then finish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                z, n = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                height = min(band, shape[1] - n * band)
                sums: dict[int, list[np.ndarray]] = {}
                cells = b.column(2)[i].values
                for pz, y, x, h, w, data in zip(*[cells.field(k).to_pylist() for k in range(6)], strict=True):
                    total, weight = sums.setdefault(pz, [np.zeros((height, shape[2])), np.zeros((height, shape[2]))])
                    where = (slice(y - n * band, y - n * band + h), slice(x, x + w))
                    total[where] += np.frombuffer(data).reshape(h, w)
                    weight[where] += 1
                acc = None
                for _, (total, weight) in sorted(sums.items()):
                    mean = total / np.maximum(weight, 1e-8)
                    acc = mean if acc is None else (acc + mean) / 2
                yield _table([(z, n * band, 0, height, shape[2], np.asarray(finish(acc), np.float64).ravel())], SLICES)

    grouped = pieces.groupBy("z", "band").agg(F.collect_list(F.struct("pz", "y", "x", "h", "w", "bytes")).alias("pieces"))
    return grouped.mapInArrow(run, SLICES)


def segmented_slices(slices: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], overlap: tuple[int, int, int], model: Model, method: str = "z-score", probability: float = 0.5, dtype: str = "uint8", pad_mode: str = "reflect", batch: int = 8, band: int = 64, **options) -> DataFrame:
    """SLICES of the mask: normalise, cut in patches chunk by chunk, predict, average in each chunk, blend chunks, threshold.

    Options are those of the normalisation.
    """
    top, limit = float(np.iinfo(dtype).max), intensity.logit_threshold(probability)
    cut = patches(normalize.normalized_slices(slices, method, **options), shape, size, overlap)
    return stitched(predicted(cut, shape, size, model, batch, band, pad_mode), shape, lambda logits: np.where(logits > limit, top, 0.0), band)


def segmented(vox: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], overlap: tuple[int, int, int], model: Model, **options) -> DataFrame:
    """z, y, x, v: the same from and to voxels."""
    out = to_voxels(segmented_slices(to_slices(vox), shape, size, overlap, model, **options))
    return out.select("z", "y", "x", F.col("v").cast("int").alias("v"))


def transformed(samples: DataFrame, transform: Callable[[np.ndarray], np.ndarray], keys: list[str], batch: int = 8) -> DataFrame:
    """keys and data of samples after a user's function over batches (n, values); nothing moves. Samples of one batch are of one size."""
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                some = b.slice(i, batch)
                out = np.asarray(transform(np.stack([np.asarray(x.values, np.float64) for x in some.column(len(keys))])), np.float64)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(list(out.reshape(len(out), -1)), pa.list_(pa.float64()))], some.schema.names)

    return samples.select(*keys, "data").mapInArrow(run, ", ".join([*kinds, "data array<double>"]))


def save_checkpoint(spark: SparkSession, path: str, model: str, parameters: dict, epoch: int, loss: float) -> None:
    """A registered model's name and parameters with its epoch and loss, as one line of JSON on any file system."""
    line = json.dumps({"model": model, "parameters": parameters, "epoch": epoch, "loss": loss})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_checkpoint(spark: SparkSession, path: str) -> tuple[Model, dict]:
    """The model, and what was stored about it."""
    stored = json.loads(spark.read.text(path).first().value)
    return MODELS[stored["model"]](**stored["parameters"]), stored
