"""Overlapping tiles: plans of starts, patch grids, extraction, sampling and splits.

A voxel finds its patches by arithmetic and equal joins on a short list of starts for each axis, never by a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def starts(full: int, size: int, overlap: int) -> list[int]:
    """Starts along an axis: steps of size - overlap, the last one moved back to end with the axis."""
    if not size > overlap >= 0:
        raise ValueError("a tile must be larger than its overlap")
    step = size - overlap
    return sorted({*range(0, max(0, full - size), step), max(0, full - size)})


def z_plan(spark: SparkSession, depth: int, size: int, overlap: int) -> DataFrame:
    """start, overlap (with the next chunk; 0 for the last)."""
    axis = _axis(spark, depth, size, overlap, "start")
    nxt = F.lead("start").over(Window.orderBy("start"))
    return axis.select("start", F.coalesce(size - (nxt - F.col("start")), F.lit(0)).cast("long").alias("overlap"))


def _axis(spark: SparkSession, full: int, size: int, overlap: int, name: str) -> DataFrame:
    step, last = size - overlap, max(0, full - size)
    if not size > overlap >= 0:
        raise ValueError("a tile must be larger than its overlap")
    n = -(-last // step) if last else 0  # starts before the last one
    return spark.range(n + 1).select(F.least(F.col("id") * step, F.lit(last)).alias(name)).distinct()


def patch_grid(spark: SparkSession, shape: tuple[int, int, int], size: tuple[int, int, int], overlap: tuple[int, int, int], z_offset: int = 0) -> DataFrame:
    """patch_id (z slowest), z0, y0, x0 and exclusive ends z1, y1, x1, global_z."""
    z, y, x = (_axis(spark, f, s, o, n) for f, s, o, n in zip(shape, size, overlap, ("z0", "y0", "x0"), strict=True))
    n = [len(starts(f, s, o)) for f, s, o in zip(shape, size, overlap, strict=True)]
    number = lambda c, f, s, o: F.when(F.col(c) >= max(0, f - s), F.lit(len(starts(f, s, o)) - 1)).otherwise(F.expr(f"{c} DIV {s - o}"))
    iz, iy, ix = (number(c, f, s, o) for c, f, s, o in zip(("z0", "y0", "x0"), shape, size, overlap, strict=True))
    grid = z.crossJoin(F.broadcast(y)).crossJoin(F.broadcast(x))  # a list of places, a few for each axis
    ends = [F.least(F.col(a) + s, F.lit(f)).alias(b) for a, b, s, f in zip(("z0", "y0", "x0"), ("z1", "y1", "x1"), size, shape, strict=True)]
    return grid.select(((iz * n[1] + iy) * n[2] + ix).cast("long").alias("patch_id"), "z0", "y0", "x0", *ends, (F.col("z0") + z_offset).alias("global_z"))


def covering(c: Column, full: int, size: int, overlap: int) -> Column:
    """All starts of tiles that hold coordinate c: at most a few, by arithmetic."""
    step, last = size - overlap, max(0, full - size)
    low = F.greatest(F.lit(0), F.ceil((c - size + 1) / step)).cast("long")
    high = F.least(F.floor(c / step), F.lit(-(-last // step) - 1)).cast("long")
    regular = F.when(high >= low, F.transform(F.sequence(low, F.greatest(high, low)), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))
    return F.when(c >= last, F.concat(regular, F.array(F.lit(last).cast("long")))).otherwise(regular)


def extracted(vox: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], overlap: tuple[int, int, int]) -> DataFrame:
    """Every voxel once for each patch that holds it, with z0, y0, x0: a flat explosion, no join."""
    out = vox
    for c, f, s, o in zip("zyx", shape, size, overlap, strict=True):
        out = out.withColumn(f"{c}0", F.explode(covering(F.col(c), f, s, o)))
    return out


def positive_patches(tiles: DataFrame, mask: str = "v", threshold: float = 0.5) -> DataFrame:
    """z0, y0, x0, positive: whether any voxel of the patch is foreground."""
    return tiles.groupBy("z0", "y0", "x0").agg(F.bool_or(F.col(mask) > threshold).alias("positive"))


def shuffled(key: Column, seed: int = 0) -> list[Column]:
    """An order that looks random but is the same on any engine: by a multiple of the key modulo a prime, then the key."""
    return [F.pmod((key + seed) * 7919, F.lit(1_000_003)), key]


def _ranked(items: DataFrame, key: str, seed: int, *groups: str) -> DataFrame:
    """items with r_, the rank in shuffled order (of each group), and all_, how many there are.

    The rank comes from counts of coarse buckets, so that no task orders all items: at most 245 for each group.
    """
    buckets = items.withColumn("o_", shuffled(F.col(key), seed)[0]).withColumn("b_", F.expr("o_ DIV 4096"))
    sizes = buckets.groupBy(*groups, "b_").agg(F.count("*").alias("c_"))
    below = Window.partitionBy(*groups).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*groups, "b_", F.coalesce(F.sum("c_").over(below), F.lit(0)).alias("before_"), F.sum("c_").over(Window.partitionBy(*groups)).alias("all_"))
    rank = F.row_number().over(Window.partitionBy(*groups, "b_").orderBy("o_", key)) + F.col("before_")
    return buckets.join(F.broadcast(before), [*groups, "b_"]).withColumn("r_", rank).drop("o_", "b_", "before_")


def sampled_patches(patches: DataFrame, ratio: float, key: str = "patch_id", seed: int = 0) -> DataFrame:
    """All positive patches and int(n_positive * ratio) of the others, by a shuffled order."""
    n = patches.agg(F.count_if("positive").alias("n_"))
    kept = _ranked(patches, key, seed, "positive").crossJoin(F.broadcast(n)).where(F.col("positive") | (F.col("r_") <= F.floor(F.col("n_") * ratio)))
    return kept.select(*patches.columns)


def split(items: DataFrame, val_ratio: float, key: str, seed: int = 0) -> DataFrame:
    """The first int(n * ratio) in shuffled order become ``val``, the others ``train``."""
    ranked = _ranked(items, key, seed)
    return ranked.withColumn("split", F.when(F.col("r_") <= F.floor(F.col("all_") * val_ratio), "val").otherwise("train")).drop("all_", "r_")


def squeezed(patches: DataFrame, depth: int) -> DataFrame:
    """Patches of depth 1 without their z."""
    return patches.drop("z") if depth == 1 else patches


def overlapping_files(files: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """Files (file, lo, hi) and queries (query, lo, hi), both half-open, that overlap, with the local bounds z0, z1.

    Both sides go to the blocks of z that they touch and meet there by an equal join; the pair counts in the first
    block that both touch, so none comes twice.
    """
    def spread(df: DataFrame) -> DataFrame:
        return df.where("hi > lo").withColumn("block_", F.explode(F.sequence(F.expr(f"lo DIV {block}"), F.expr(f"(hi - 1) DIV {block}"))))

    f, q = spread(files), spread(queries).withColumnsRenamed({"lo": "q_lo", "hi": "q_hi"})
    pairs = f.join(q, "block_").where((F.col("lo") < F.col("q_hi")) & (F.col("hi") > F.col("q_lo")) & (F.col("block_") == F.expr(f"greatest(lo, q_lo) DIV {block}")))
    return pairs.select("query", "file", (F.greatest("lo", "q_lo") - F.col("lo")).alias("z0"), (F.least("hi", "q_hi") - F.col("lo")).alias("z1"))


def stitched_ranges(files: DataFrame, *order: Column) -> DataFrame:
    """file, lo, hi from file and dz: files in the given order and that of their names, one after the other along z."""
    up_to = F.sum("dz").over(Window.orderBy(*order, "file").rowsBetween(Window.unboundedPreceding, 0))
    return files.select("file", (up_to - F.col("dz")).alias("lo"), up_to.alias("hi"))


def box(vox: DataFrame, z: tuple[int, int], y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Half-open box; negative starts count as 0, an empty box gives no rows. The comparisons reach the scan."""
    out = vox
    for c, (a, b) in zip("zyx", (z, y, x), strict=True):
        out = out.where((F.col(c) >= max(0, a)) & (F.col(c) < b))
    return out
