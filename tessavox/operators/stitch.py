"""Reassembly: mean over the patches of a chunk, then an ordered blend over the chunks that share a voxel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessavox.operators.tiling import covering


def patch_means(tiles: DataFrame, shape: tuple[int, int, int] | None = None, *chunk: str) -> DataFrame:
    """chunk, z, y, x, v: mean of all patches over each voxel; places outside the shape are dropped."""
    if shape:
        for c, n in zip("zyx", shape, strict=True):
            tiles = tiles.where((F.col(c) >= 0) & (F.col(c) < n))
    return tiles.groupBy(*chunk, "z", "y", "x").agg(F.avg("v").alias("v"))


def folded(values: Column) -> Column:
    """acc = first, then (acc + next) / 2 for each further one: the later ones weigh more."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda acc, v: (acc + v) / 2)


def blended(chunks: DataFrame, start: str = "z0") -> DataFrame:
    """z, y, x, v: the chunks over each voxel folded in the order of their starts; at most a few share a voxel."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(start, "v"))), lambda s: s["v"])
    return chunks.groupBy("z", "y", "x").agg(ordered.alias("vs")).select("z", "y", "x", folded(F.col("vs")).alias("v"))


def chunked(vox: DataFrame, depth: int, size: int, overlap: int) -> DataFrame:
    """Every voxel once for each z chunk of the plan that covers it."""
    return vox.withColumn("z0", F.explode(covering(F.col("z"), depth, size, overlap)))
