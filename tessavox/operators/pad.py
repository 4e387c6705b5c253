"""Padding as a gather: every output place knows the input place it copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("constant", "edge", "reflect", "symmetric")


def widths(full: int, size: int, both_sides: bool) -> tuple[int, int]:
    """What brings an axis up to the size: along z half on each side (the larger half behind), else all behind."""
    missing = max(0, size - full)
    before = missing // 2 if both_sides else 0
    return before, missing - before


def multiple_widths(full: int, multiple: int = 32) -> tuple[int, int]:
    missing = -full % multiple
    return missing // 2, missing - missing // 2


def targets(c: Column, n: int, before: int, after: int, mode: str) -> Column:
    """All output places (0 .. before + n + after - 1) that copy input place c, as an array."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    own = F.array((c + before).cast("long"))
    if mode == "constant" or before + after == 0:
        return own
    if mode == "edge":
        front = F.when((c == 0) & F.lit(before > 0), F.sequence(F.lit(0).cast("long"), F.lit(max(0, before - 1)).cast("long")))
        back = F.when((c == n - 1) & F.lit(after > 0), F.sequence(F.lit(before + n).cast("long"), F.lit(before + n + max(1, after) - 1).cast("long")))
        empty = F.array().cast("array<bigint>")
        return F.concat(own, F.coalesce(front, empty), F.coalesce(back, empty))
    period = max(1, 2 * (n - 1)) if mode == "reflect" else 2 * n
    twin = -c if mode == "reflect" else -c - 1
    total = before + n + after
    periods = F.sequence(F.lit(-(before // period) - 2), F.lit(total // period + 2))

    def repeated(at: Column) -> Column:
        return F.transform(periods, lambda k: (at + k * period + before).cast("long"))

    places = F.concat(repeated(c), repeated(twin))
    return F.array_distinct(F.filter(places, lambda o: (o >= 0) & (o < total)))


def padded(vox: DataFrame, shape: tuple[int, int, int], pads: tuple[tuple[int, int], ...], mode: str = "reflect", fill: float = 0.0) -> DataFrame:
    """z, y, x, v of the padded volume: each voxel is sent to the places that copy it; only a constant border is made anew."""
    out = vox.select("z", "y", "x", "v")
    for c, n, (a, b) in zip("zyx", shape, pads, strict=True):
        out = out.withColumn(c, F.explode(targets(F.col(c), n, a, b, mode)))
    if mode != "constant":
        return out
    spark = vox.sparkSession
    sizes = [n + a + b for n, (a, b) in zip(shape, pads, strict=True)]
    every = spark.range(sizes[0] * sizes[1] * sizes[2]).select(*[F.expr(f"id DIV {d} % {m}").alias(c) for c, d, m in zip("zyx", (sizes[1] * sizes[2], sizes[2], 1), sizes, strict=True)])
    inside = F.lit(True)
    for c, n, (a, _) in zip("zyx", shape, pads, strict=True):
        inside &= (F.col(c) >= a) & (F.col(c) < n + a)
    return out.union(every.where(~inside).select("z", "y", "x", F.lit(float(fill)).alias("v")))
