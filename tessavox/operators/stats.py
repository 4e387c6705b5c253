"""Global statistics of voxel values in one pass: sums are partial in each task and meet as one row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accumulators(v: str = "v") -> list[Column]:
    c = F.col(v)
    return [F.count(c).alias("n"), F.sum(c).alias("sx"), F.sum(c * c).alias("sx2"), F.min(c).alias("min"), F.max(c).alias("max")]


def mean_std(n: Column, sx: Column, sx2: Column) -> tuple[Column, Column]:
    """Mean and population deviation, from sums that may come from many parts."""
    mean = F.coalesce(F.try_divide(sx, n), F.lit(0.0))
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(sx2, n), F.lit(0.0)) - mean * mean))


def statistics(vox: DataFrame, *groups: str, v: str = "v") -> DataFrame:
    """groups, n, mean, std, min, max; without groups one row, also of an empty volume."""
    mean, std = mean_std(F.col("n"), F.col("sx"), F.col("sx2"))
    return vox.groupBy(*groups).agg(*accumulators(v)).select(*groups, "n", mean.alias("mean"), std.alias("std"), "min", "max")


def sampled(vox: DataFrame, rate: float, chunk: int = 128, z: str = "z") -> DataFrame:
    """Every int(1/rate)-th chunk of slices; the filter reads z only."""
    step = max(1, int(1.0 / rate)) if rate < 1.0 else 1
    return vox.where(F.expr(f"(`{z}` DIV {chunk}) % {step} = 0"))


def chunk_size(slice_bytes: int, memory_bytes: int) -> int:
    """Slices of a chunk: a tenth of the memory, 1 to 128."""
    return min(128, max(1, int(memory_bytes * 0.1 / slice_bytes)))


def bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    """Bin of [low, high); high itself falls into the last; null beyond."""
    i = F.least(F.floor((v - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return F.when((v >= low) & (v < high), i).when(v == high, F.lit(bins - 1))


def histogram(vox: DataFrame, low: float, high: float, bins: int, v: str = "v") -> DataFrame:
    """bin, n with all bins, empty ones too."""
    counts = vox.select(bin_of(F.col(v), low, high, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = vox.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def cdf(hist: DataFrame, bins: int) -> DataFrame:
    """bin, cdf: running share of a histogram; an empty one rises evenly. One row for each bin, so one task orders them."""
    total = F.sum("n").over(Window.partitionBy())
    running = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    even = F.col("bin") / F.lit(float(max(1, bins - 1)))
    return hist.select("bin", F.when(total > 0, running / F.greatest(total, F.lit(1))).otherwise(even).alias("cdf"))


def cdf_array(hist: DataFrame, bins: int) -> DataFrame:
    """One row: the running shares as an array in the order of bins."""
    return cdf(hist, bins).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "cdf"))), lambda s: s["cdf"]).alias("cdf"))


def metadata(vox: DataFrame, dtype: str = "float32") -> DataFrame:
    """One row: depth, height, width, dtype, size_gb, mean, std, min, max."""
    size = {"uint8": 1, "uint16": 2, "float32": 4, "float64": 8}[dtype]
    shape = [(F.max(c) + 1).alias(n) for c, n in (("z", "depth"), ("y", "height"), ("x", "width"))]
    mean, std = mean_std(F.col("n"), F.col("sx"), F.col("sx2"))
    one = vox.agg(*shape, *accumulators())
    return one.select("depth", "height", "width", F.lit(dtype).alias("dtype"), (F.col("depth") * F.col("height") * F.col("width") * size / F.lit(float(1 << 30))).alias("size_gb"), mean.alias("mean"), std.alias("std"), "min", "max")


def fits_memory(size_gb: float, limit_gb: float, zarr: bool = False) -> bool:
    """The guard before a read: twice the size must fit, except for chunked stores."""
    return zarr or 2 * size_gb <= limit_gb


def consistency(vox: DataFrame, files: Column) -> DataFrame:
    """One row: n_files, n_shapes, consistent; a volume's files must agree in height and width."""
    by_file = vox.groupBy(files.alias("file")).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return by_file.agg(F.count("*").alias("n_files"), F.count_distinct("height", "width").alias("n_shapes")).withColumn("consistent", F.col("n_shapes") <= 1)


def entropy(hist: DataFrame) -> DataFrame:
    """One row: Shannon entropy of a histogram, in bits."""
    total = hist.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return hist.where("n > 0").crossJoin(F.broadcast(total)).agg((-F.sum(share * F.log(share)) / math.log(2)).alias("entropy"))
