"""Exact Euclidean distances to masks in time linear in the pixels, and robust Hausdorff distances of whole slices or of their strips.

The transform is separable: along columns by running extremes, then along rows by the lower envelope of the columns' parabolas, for
many rows at a time. Slices beyond a task's memory are worked on in strips: strips of columns give the distances along
columns, these meet again as strips of rows, and what leaves a strip are counts of squared distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessavox.operators.grouped import gathered, kind, stacks, worked_together

#: Stands for no pixel of the mask in a column.
FAR = np.int64(1) << 40
#: Pixels of the rows whose envelopes are made together.
TOGETHER = 1 << 22


def along_columns(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the nearest one of the mask in its column, for a stack of slices; FAR without one."""
    height = mask.shape[1]
    rows = np.arange(height, dtype=np.int32)[:, None]
    none = np.int32(1 << 29)
    above = np.maximum.accumulate(np.where(mask, rows, -none), axis=1)
    below = np.minimum.accumulate(np.where(mask, rows, none)[:, ::-1], axis=1)[:, ::-1]
    near = np.minimum(rows - above, below - rows).astype(np.int64)
    return np.where(near >= none // 2, FAR, near * near)


def along_rows(columns: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the mask, from the squared distances along columns of any number of rows (row, x)."""
    out = np.empty(columns.shape, np.int64)
    step = max(1, TOGETHER // max(1, columns.shape[1]))
    for i in range(0, len(columns), step):
        out[i : i + step] = _enveloped(columns[i : i + step])
    return out


def _enveloped(g: np.ndarray) -> np.ndarray:
    """The lower envelope of each row's parabolas g + (x - u)^2: a stack of those that are lowest somewhere, and from where on.

    A parabola goes on the stack once and off it once, so the work is in proportion to the pixels.
    """
    count, width = g.shape
    every = np.arange(count)
    top = np.full(count, -1)
    who, since = np.zeros((count, width), np.int32), np.zeros((count, width), np.int32)
    for u in np.flatnonzero((g < FAR).any(axis=0)).tolist():
        new = g[:, u]
        open_ = every[new < FAR]
        live = open_[top[open_] >= 0]
        while len(live):
            k = top[live]
            s, t = who[live, k].astype(np.int64), since[live, k].astype(np.int64)
            lower = g[live, s] + (t - s) ** 2 > new[live] + (t - u) ** 2  # the new one is lower where the last one begins
            live = live[lower]
            top[live] -= 1
            live = live[top[live] >= 0]
        bare = open_[top[open_] < 0]
        top[bare] = 0
        who[bare, 0], since[bare, 0] = u, 0
        rest = open_[who[open_, top[open_]] != u]
        s = who[rest, top[rest]].astype(np.int64)
        start = 1 + (u * u - s * s + new[rest] - g[rest, s]) // (2 * (u - s))
        inside = start < width
        rest, start = rest[inside], start[inside]
        top[rest] += 1
        who[rest, top[rest]], since[rest, top[rest]] = u, start
    if not count or (top < 0).any():
        found = top >= 0
        out = np.full(g.shape, FAR)
        if found.any():
            out[found] = _enveloped(g[found])
        return out
    held = np.arange(width)[None, :] <= top[:, None]
    until = np.where(np.arange(width)[None, :] < top[:, None], np.roll(since, -1, axis=1), width)
    u = np.repeat(who[held], (until - since)[held]).reshape(count, width)
    x = np.arange(width)[None, :]
    return np.take_along_axis(g, u.astype(np.int64), axis=1) + (x - u).astype(np.int64) ** 2


def squared(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel to the nearest pixel of its slice's mask, for a stack; FAR in slices without one."""
    out = np.full(mask.shape, FAR)
    some = np.flatnonzero(mask.any(axis=(1, 2)))
    if len(some):
        columns = along_columns(mask[some])
        out[some] = along_rows(columns.reshape(-1, mask.shape[2])).reshape(columns.shape)
    return out


def distances(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest pixel of its slice's mask (one slice or a stack); infinite in slices without one."""
    if mask.ndim == 2:
        return distances(mask[None])[0]
    found = squared(mask)
    return np.where(found >= FAR, np.inf, np.sqrt(found))


def robust_hausdorff(gt: np.ndarray, pr: np.ndarray, percentile: float = 95.0) -> list[float | None]:
    """Of each slice of two stacks the larger of both directed percentiles of the distances to the other mask; None if one is empty."""
    both = np.flatnonzero(gt.any(axis=(1, 2)) & pr.any(axis=(1, 2)))
    out: list[float | None] = [None] * len(gt)
    if len(both):
        a, b = gt[both], pr[both]
        to_gt, to_pr = squared(a), squared(b)
        for j, i in enumerate(both.tolist()):
            out[i] = max(_percentile(to_gt[j][b[j]], percentile), _percentile(to_pr[j][a[j]], percentile))
    return out


def _percentile(d2: np.ndarray, percentile: float) -> float:
    """Of the roots, between neighbours in proportion."""
    at = (len(d2) - 1) * percentile / 100
    low, high = math.floor(at), math.ceil(at)
    found = np.partition(d2, (low, high))
    a, b = math.sqrt(found[low]), math.sqrt(found[high])
    return a + (b - a) * (at - low)


def hausdorff(rows: DataFrame, *slice_cols: str, percentile: float = 95.0, tile: int | None = None) -> DataFrame:
    """slice, hausdorff of each slice (``z``, or several key columns) of y, x, gt, pr; slices with an empty mask are left out.

    With ``tile`` no task holds more of a slice than a strip of that many columns or rows; the values are the same.
    """
    keys = list(slice_cols or ("z",))
    if tile is not None:
        return _by_strips(rows, keys, percentile, tile)

    def work(groups: Iterator[tuple]) -> Iterator[tuple]:
        for some in stacks(groups, len(keys)):
            found = robust_hausdorff(np.stack([g for _, g, _ in some]), np.stack([p for _, _, p in some]), percentile)
            yield from ((*key, h) for (key, _, _), h in zip(some, found, strict=True) if h is not None)

    return worked_together(rows, [F.col(k) for k in keys], ["y", "x", "gt", "pr"], work, ", ".join([f"{k} {kind(rows, k)}" for k in keys] + ["hausdorff double"]))


def _by_strips(rows: DataFrame, keys: list[str], percentile: float, tile: int) -> DataFrame:
    n = len(keys)
    named = [F.col(f"k{i}_") for i in range(n)]
    plain = rows.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.col("gt") > 0).alias("gt"), (F.col("pr") > 0).alias("pr"))
    kinds = [f"k{i}_ {kind(rows, k)}" for i, k in enumerate(keys)]
    # rows of a slice by its strips of columns; heights may differ, what is missing is background
    height = plain.groupBy(*named).agg(F.max("y").alias("top_"))
    strips = gathered(plain, [*named, F.expr(f"x DIV {tile}")], ["y", "x", "gt", "pr"]).withColumnRenamed(f"k{n}_", "strip_").join(height, [f"k{i}_" for i in range(n)])
    block = ", ".join([*kinds, "band_ int, x0_ int, height_ int, width_ int, to_gt_ binary, to_pr_ binary, masks_ binary"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, held = [], 0
            for i in range(b.num_rows):
                cells = b.column("cells_")[i].values
                y, x, gt, pr = (np.asarray(cells.field(j).to_numpy(zero_copy_only=False)) for j in range(4))
                x0 = b.column("strip_")[i].as_py() * tile
                masks = np.zeros((2, b.column("top_")[i].as_py() + 1, int(x.max()) - x0 + 1), bool)
                masks[0, y, x - x0], masks[1, y, x - x0] = gt, pr
                to = along_columns(masks)
                key = tuple(b.column(f"k{j}_")[i].as_py() for j in range(n))
                for y0 in range(0, masks.shape[1], tile):
                    cut = slice(y0, y0 + tile)
                    part = masks[:, cut]
                    made.append((*key, y0 // tile, x0, part.shape[1], part.shape[2], to[0, cut].tobytes(), to[1, cut].tobytes(), np.packbits(part).tobytes()))
                held += masks.size
                if held >= TOGETHER:
                    yield _batch(made, block)
                    made, held = [], 0
            if made:
                yield _batch(made, block)

    counts = ", ".join([*kinds, "way_ int, d2_ long, n_ long"])

    def counted(strips_: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of rows of one width: key, distances to both masks and the masks of each strip."""
        to, masks = (np.concatenate([s[i] for s in strips_], axis=1) for i in (1, 2))
        until = np.cumsum([s[1].shape[1] for s in strips_]).tolist()
        out = []
        for way in (0, 1):
            far = along_rows(to[way])
            for (key, *_), first, last in zip(strips_, [0, *until], until, strict=False):
                d2, many = np.unique(far[first:last][masks[1 - way, first:last]], return_counts=True)
                if len(d2) and d2[0] < FAR:
                    out.extend((*key, way, a, m) for a, m in zip(d2.tolist(), many.tolist(), strict=True))
        if out:
            yield _batch(out, counts)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, list[tuple]] = {}
            size: dict[int, int] = {}
            for i in range(b.num_rows):
                blocks = sorted(b.column("blocks_")[i].as_py(), key=lambda c: c["x0_"])
                width, tall = blocks[-1]["x0_"] + blocks[-1]["width_"], blocks[0]["height_"]
                to, masks = np.full((2, tall, width), FAR), np.zeros((2, tall, width), bool)
                for c in blocks:
                    at = slice(c["x0_"], c["x0_"] + c["width_"])
                    part = (tall, c["width_"])
                    to[0, :, at], to[1, :, at] = (np.frombuffer(c[name], np.int64).reshape(part) for name in ("to_gt_", "to_pr_"))
                    masks[:, :, at] = np.unpackbits(np.frombuffer(c["masks_"], np.uint8), count=2 * part[0] * part[1]).reshape(2, *part)
                held.setdefault(width, []).append((tuple(b.column(f"k{j}_")[i].as_py() for j in range(n)), to, masks))
                size[width] = size.get(width, 0) + masks.size
                if size[width] >= TOGETHER:
                    yield from counted(held.pop(width))
                    del size[width]
            for some in held.values():
                yield from counted(some)

    blocks = strips.mapInArrow(down, block)
    fields = ["x0_", "height_", "width_", "to_gt_", "to_pr_", "masks_"]
    bands = blocks.groupBy(*named, "band_").agg(F.collect_list(F.struct(*fields)).alias("blocks_"))
    found = bands.mapInArrow(across, counts).groupBy(*named, "way_", "d2_").agg(F.sum("n_").alias("n_"))
    ways = found.groupBy(*named, "way_").agg(F.percentile(F.sqrt("d2_"), F.lit(percentile / 100), F.col("n_")).alias("far_"))
    return ways.groupBy(*named).agg(F.max("far_").alias("hausdorff")).select(*[F.col(f"k{i}_").alias(k) for i, k in enumerate(keys)], "hausdorff")


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    schema = _arrow(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(fields: str) -> pa.Schema:
    known = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(f.split(" ")[0], known[f.split(" ")[1]]) for f in fields.split(", ")])
