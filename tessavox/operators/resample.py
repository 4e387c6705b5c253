"""Resizing, pyramids and reslicing on coordinates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessavox.operators.lineage import cut


def sources(n_in: int, n_out: int) -> list[int]:
    """Nearest input place of each output place: centres are matched."""
    return [min(n_in - 1, int((o + 0.5) * n_in / n_out)) for o in range(n_out)]


def _copies(c: Column, n_in: int, n_out: int) -> Column:
    """All output places whose nearest input place is c, as an array."""
    ratio = n_out / n_in
    near = F.sequence(F.floor(c * ratio - 1.5).cast("long"), F.ceil((c + 1) * ratio + 0.5).cast("long"))
    source = lambda o: F.least(F.lit(n_in - 1).cast("long"), F.floor((o + 0.5) * n_in / n_out).cast("long"))
    return F.filter(near, lambda o: (o >= 0) & (o < n_out) & (source(o) == c))


def nearest(vox: DataFrame, shape: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """z, y, x, v of the resized volume, order 0: each voxel goes to the places that copy it, nothing is joined."""
    out = vox.select("z", "y", "x", "v")
    for c, a, b in zip("zyx", shape, new, strict=True):
        if a != b:
            out = out.withColumn(c, F.explode(_copies(F.col(c), a, b)))
    return out


def linear(vox: DataFrame, shape: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """Order 1 without smoothing, an axis at a time: each output place adds two weighted neighbours."""
    out = vox.select("z", "y", "x", "v")
    for c, a, b in zip("zyx", shape, new, strict=True):
        if a != b:
            spread = out.withColumn("t_", F.explode(_taps(F.col(c), a, b))).withColumn(c, F.col("t_.o"))
            out = spread.groupBy("z", "y", "x").agg(F.sum(F.col("v") * F.col("t_.w")).alias("v"))
    return out


def _taps(c: Column, n_in: int, n_out: int) -> Column:
    """Output places (o) to which input place c adds, with its weight (w)."""
    scale = n_in / n_out
    near = F.sequence(F.floor((c - 1) / scale - 1).cast("long"), F.ceil((c + 1) / scale + 1).cast("long"))

    def tap(o: Column) -> Column:
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(n_in - 1)), (o + 0.5) * scale - 0.5))
        return F.struct(o.alias("o"), F.greatest(F.lit(0.0), 1 - F.abs(at - c)).alias("w"))

    return F.filter(F.transform(F.filter(near, lambda o: (o >= 0) & (o < n_out)), tap), lambda t: t["w"] > 0)


def levels(shape: tuple[int, int, int], n: int, factor: int) -> list[tuple[int, int, int]]:
    """Shapes of a pyramid: each side divided and cut; ends before a side would vanish."""
    out = [shape]
    while len(out) < n and min(s // factor for s in out[-1]) >= 1:
        out.append(tuple(s // factor for s in out[-1]))
    return out


def pyramid(vox: DataFrame, shape: tuple[int, int, int], n: int, factor: int = 2) -> DataFrame:
    """level, z, y, x, v; level i is made from level i - 1, which is written before."""
    shapes = levels(shape, n, factor)
    now = vox.select("z", "y", "x", "v")
    out = now.select(F.lit(0).alias("level"), "*")
    for i in range(1, len(shapes)):
        now = nearest(now, shapes[i - 1], shapes[i])
        now = cut(now) if i + 1 < len(shapes) else now
        out = out.unionByName(now.select(F.lit(i).alias("level"), "*"))
    return out


def ome_metadata(n_levels: int, factor: int) -> str:
    """The multiscales block (version 0.4) of a pyramid's sidecar file."""
    sets = [{"path": str(i), "coordinateTransformations": [{"type": "scale", "scale": [factor**i] * 3}]} for i in range(n_levels)]
    axes = [{"name": c, "type": "space"} for c in "zyx"]
    return json.dumps([{"version": "0.4", "name": "image", "axes": axes, "datasets": sets}])


def resliced(vox: DataFrame, shape: tuple[int, int, int], axis: int, name: str = "volume") -> DataFrame:
    """file, slice, row, col, v along axis 0-2 (z, y, x) or 3-5 (the same, last slice first)."""
    if not 0 <= axis <= 5:
        raise ValueError("axis must be 0 to 5")
    a = axis % 3
    c = "zyx"[a]
    rest = [d for d in "zyx" if d != c]
    number = F.col(c) if axis < 3 else shape[a] - 1 - F.col(c)
    return vox.select(F.format_string(f"{name}_{c}%05d", number).alias("file"), number.cast("long").alias("slice"), F.col(rest[0]).alias("row"), F.col(rest[1]).alias("col"), "v")
