"""Connected objects of masks, their matching and centre lines. A slice is one group: its pixels bound a task's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessavox.operators.distance import robust_hausdorff
from tessavox.operators.grouped import STACK, grid, kind, stacks, worked, worked_together

_ALL = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) > (0, 0)]


def labels(mask: np.ndarray, connectivity: int = 2) -> np.ndarray:
    """Objects of a slice, or of each slice of a stack, numbered from 1 in the order of their first pixels; connectivity 1 leaves
    out diagonals."""
    if mask.ndim == 2:
        return labels(mask[None], connectivity)[0]
    height, width = mask.shape[1:]
    root = np.arange(mask.size).reshape(mask.shape)
    flat = root.ravel()
    links = []
    for dy, dx in _ALL if connectivity != 1 else [(0, 1), (1, 0)]:
        a = (slice(None), slice(0, height - dy), slice(max(0, -dx), width - max(0, dx)))
        b = (slice(None), slice(dy, height), slice(max(0, dx), width + min(0, dx)))
        both = mask[a] & mask[b]
        links.append((root[a][both], root[b][both]))
    one, other = (np.concatenate(x) for x in zip(*links, strict=True))
    while True:
        low, high = np.minimum(flat[one], flat[other]), np.maximum(flat[one], flat[other])
        apart = low != high
        if not apart.any():
            break
        one, other = one[apart], other[apart]
        np.minimum.at(flat, high[apart], low[apart])  # roots take the smaller one
        while True:
            up = flat[flat]
            if (up == flat).all():
                break
            flat[:] = up
    out = np.zeros(mask.size, np.int64)
    inside = mask.ravel()
    roots, number = np.unique(flat[inside], return_inverse=True)
    first = np.searchsorted(roots, np.arange(len(mask)) * height * width)  # of each slice
    out[inside] = number + 1 - np.repeat(first, mask.reshape(len(mask), -1).sum(axis=1))
    return out.reshape(mask.shape)


def without_small(numbered: np.ndarray, min_size: int, connectivity: int = 2) -> np.ndarray:
    """A slice's objects of at least min_size pixels, numbered anew."""
    if min_size <= 0:
        return numbered
    keep = np.bincount(numbered.ravel()) >= min_size
    keep[0] = False
    return labels(keep[numbered], connectivity)


def matched(gt: np.ndarray, pr: np.ndarray, min_iou: float = 0.5) -> int:
    """Predicted objects, in order, each take the first overlapping true object that is free and overlaps enough."""
    meet = (gt > 0) & (pr > 0)
    most = int(gt.max()) + 1
    pairs, n = np.unique(pr[meet] * most + gt[meet], return_counts=True)
    size_gt, size_pr = np.bincount(gt.ravel()), np.bincount(pr.ravel())
    used, done, hits = set(), set(), 0
    for pair, both in zip(pairs.tolist(), n.tolist(), strict=True):  # sorted by prediction, then truth
        p, g = divmod(pair, most)
        if p not in done and g not in used and both / (size_pr[p] + size_gt[g] - both) >= min_iou:
            used.add(g)
            done.add(p)
            hits += 1
    return hits


def thinned(mask: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Centre lines of a slice or of each of a stack: pixels go in two alternating passes while a loop's or line's connection stays
    (Zhang and Suen 1984); on request after some rounds of both passes only."""
    if mask.ndim == 2:
        return thinned(mask[None], rounds)[0]
    m = np.pad(mask.astype(np.int8), ((0, 0), (1, 1), (1, 1)))
    live = np.arange(len(m))
    while len(live) and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        some, gone = m[live], np.zeros(len(live), bool)
        for first in (True, False):
            p = [some[:, :-2, 1:-1], some[:, :-2, 2:], some[:, 1:-1, 2:], some[:, 2:, 2:], some[:, 2:, 1:-1], some[:, 2:, :-2], some[:, 1:-1, :-2], some[:, :-2, :-2]]
            count = sum(p[1:], p[0])
            turns = sum(((1 - a) & b for a, b in zip(p[1:], [*p[2:], p[0]], strict=True)), (1 - p[0]) & p[1])
            n, e, s, w = p[0], p[2], p[4], p[6]
            side = (n * e * s == 0) & (e * s * w == 0) if first else (n * e * w == 0) & (n * s * w == 0)
            drop = (some[:, 1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & side
            some[:, 1:-1, 1:-1][drop] = 0
            gone |= drop.any(axis=(1, 2))
        m[live] = some
        live = live[gone]
    return m[:, 1:-1, 1:-1].astype(bool)


def centre_dice(gt: np.ndarray, pr: np.ndarray) -> np.ndarray | float:
    """Harmonic mean of how much of each centre line the other mask covers, for a slice or each of a stack; 0 for an empty mask."""
    if gt.ndim == 2:
        return float(centre_dice(gt[None], pr[None])[0])
    a, b = thinned(gt), thinned(pr)
    total = lambda x: x.sum(axis=(1, 2))
    precision, recall = total(a & pr) / (total(a) + 1e-6), total(b & gt) / (total(b) + 1e-6)
    both = precision + recall
    fine = gt.any(axis=(1, 2)) & pr.any(axis=(1, 2)) & (both > 0)
    return np.where(fine, 2 * precision * recall / np.where(fine, both, 1), 0.0)


def object_metrics(rows: DataFrame, *slice_cols: str, min_iou: float = 0.5, min_size: int = 0, connectivity: int = 2, hd_percentile: float = 95.0) -> DataFrame:
    """slice, gt_count, pr_count, matched, obj_precision, obj_recall, obj_f1, cldice and hausdorff (null if a mask is empty) of each
    slice (``z``, or several key columns)."""
    keys = list(slice_cols or ("z",))

    def work(groups: Iterator[tuple]) -> Iterator[tuple]:
        for some in stacks(groups, len(keys)):
            names, g, p = [k for k, _, _ in some], np.stack([a for _, a, _ in some]), np.stack([b for _, _, b in some])
            lg, lp, lines, far = labels(g, connectivity), labels(p, connectivity), centre_dice(g, p), robust_hausdorff(g, p, hd_percentile)
            for i, key in enumerate(names):
                a, b = (without_small(x[i], min_size, connectivity) for x in (lg, lp))
                ng, np_ = int(a.max()), int(b.max())
                hits = matched(a, b, min_iou) if ng and np_ else 0
                precision, recall = hits / np_ if ng and np_ else 0.0, hits / ng if ng and np_ else 0.0
                f1 = 2 * precision * recall / (precision + recall) if hits else 0.0
                yield (*key, ng, np_, hits, precision, recall, f1, float(lines[i]), far[i])

    schema = ", ".join([f"{k} {kind(rows, k)}" for k in keys] + ["gt_count long", "pr_count long", "matched long", "obj_precision double", "obj_recall double", "obj_f1 double", "cldice double", "hausdorff double"])
    return worked_together(rows, [F.col(k) for k in keys], ["y", "x", "gt", "pr"], work, schema)


def _contracted(edges: DataFrame) -> DataFrame:
    """a, b: the least node of each linked node's component, by alternating large and small stars; edges: a > b, different ones."""
    from tessavox.operators.lineage import cut

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = state(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = cut(both.join(least, F.col("a") == F.col("u")).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        new = state(edges)
        if new == was:
            break
        was = new
    return edges


def tiled_metrics(rows: DataFrame, *slice_cols: str, tile: int = 512, min_iou: float = 0.5, min_size: int = 0, connectivity: int = 2) -> DataFrame:
    """slice, gt_count, pr_count, matched, obj_precision, obj_recall, obj_f1 as ``object_metrics`` has them, of slices of any size.

    Objects are numbered inside tiles, by their first pixels; where tiles touch, numbers of one object meet by equal joins and are
    contracted. Sizes and overlaps are sums over tiles. The greedy matching takes, in rounds, all pairs that come first both for
    their prediction and for their truth, which is what one pass in order takes.
    """
    from tessavox.operators.lineage import cut

    keys = list(slice_cols or ("z",))
    ks = [f"k{i}_" for i in range(len(keys))]
    kinds = [f"{k} {kind(rows, c)}" for k, c in zip(ks, keys, strict=True)]
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0) and (connectivity != 1 or not (dy and dx))]

    def work(*group) -> list[tuple]:
        key, (ty, tx, y, x, gt, pr) = group[: len(keys)], group[len(keys) :]
        y0, x0 = ty * tile, tx * tile
        numbered, first, out = [], [], []
        for which, v in enumerate((gt, pr)):
            a = labels(grid(y - y0, x - x0, v > 0, "bool", (tile, tile)), connectivity)
            at, where, sizes = np.unique(a, return_index=True, return_counts=True)
            place = np.zeros(len(at) + 1, np.int64)
            place[at] = (where // tile + y0) << 32 | (where % tile + x0)
            numbered.append(a)
            first.append(place)
            for n, size in zip(at.tolist(), sizes.tolist(), strict=True):
                if n:
                    out.append((*key, 0, which, int(place[n]), 0, size))
            border = np.zeros_like(a)
            border[[0, -1]], border[:, [0, -1]] = a[[0, -1]], a[:, [0, -1]]
            out += [(*key, 1, which, int(place[a[i, j]]), (i + y0) << 32 | (j + x0), 1) for i, j in zip(*(c.tolist() for c in np.nonzero(border)), strict=True)]
        meet = (numbered[0] > 0) & (numbered[1] > 0)
        pairs, n = np.unique(np.stack([numbered[1][meet], numbered[0][meet]]), axis=1, return_counts=True)
        out += [(*key, 2, 0, int(first[1][p]), int(first[0][g]), int(m)) for p, g, m in zip(*pairs.tolist(), n.tolist(), strict=True)]
        return out

    schema = ", ".join([*kinds, "what_ int, which_ int, id_ long, at_ long, n_ long"])
    found = cut(worked(rows, [*[F.col(k) for k in keys], F.expr(f"CAST(y DIV {tile} AS INT)"), F.expr(f"CAST(x DIV {tile} AS INT)")], ["y", "x", "gt", "pr"], work, schema))

    def node(which, place) -> Column:
        return F.struct(*ks, which, place)

    edge = found.where("what_ = 1").select(*ks, "which_", "id_", "at_")
    near = edge.select(*ks, "which_", F.col("id_").alias("other_"), F.explode(F.array(*[F.col("at_") + F.lit(dy * (1 << 32) + dx).cast("long") for dy, dx in steps])).alias("at_"))
    links = edge.join(near, [*ks, "which_", "at_"]).where("id_ > other_").select(node(F.col("which_").alias("w"), F.col("id_").alias("i")).alias("a"), node(F.col("which_").alias("w"), F.col("other_").alias("i")).alias("b"))
    roots = _contracted(cut(links.distinct()))

    def rooted(df: DataFrame, which, place: str) -> DataFrame:
        own = df.withColumn("a", node(F.lit(which).cast("int").alias("w") if isinstance(which, int) else F.col(which).alias("w"), F.col(place).alias("i")))
        return own.join(roots, "a", "left").withColumn(place, F.coalesce("b.i", place)).drop("a", "b")

    sizes = rooted(found.where("what_ = 0"), "which_", "id_").groupBy(*ks, "which_", "id_").agg(F.sum("n_").alias("size")).where(F.col("size") >= min_size)
    sizes = cut(sizes)
    counts = sizes.groupBy(*ks).agg(F.count_if(F.col("which_") == 0).alias("gt_count"), F.count_if(F.col("which_") == 1).alias("pr_count"))
    both = rooted(rooted(found.where("what_ = 2"), 1, "id_"), 0, "at_").groupBy(*ks, F.col("id_").alias("p"), F.col("at_").alias("g")).agg(F.sum("n_").alias("both"))
    size = lambda which, name: sizes.where(F.col("which_") == which).select(*ks, F.col("id_").alias(name), F.col("size").alias(f"size_{name}"))
    left = both.join(size(1, "p"), [*ks, "p"]).join(size(0, "g"), [*ks, "g"]).where(F.col("both") / (F.col("size_p") + F.col("size_g") - F.col("both")) >= min_iou)
    left, taken = cut(left.select(*ks, "p", "g")), None
    while not left.isEmpty():
        ranked = left.withColumn("first_g", F.min("g").over(Window.partitionBy(*ks, "p"))).withColumn("first_p", F.min("p").over(Window.partitionBy(*ks, "g")))
        hits = cut(ranked.where("g = first_g AND p = first_p").select(*ks, "p", "g"))
        taken = hits if taken is None else taken.union(hits)
        left = cut(left.join(hits.drop("g"), [*ks, "p"], "left_anti").join(hits.drop("p"), [*ks, "g"], "left_anti"))
    matched_ = (left if taken is None else taken).groupBy(*ks).agg(F.count("*").alias("matched"))
    every = rows.select(*[F.col(c).alias(k) for k, c in zip(ks, keys, strict=True)]).distinct()
    out = every.join(counts, ks, "left").join(matched_, ks, "left").na.fill(0, ["gt_count", "pr_count", "matched"])
    m = F.col("matched").cast("double")
    ratio = lambda c: F.coalesce(F.try_divide(m, F.col(c)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * m, F.col("gt_count") + F.col("pr_count")), F.lit(0.0))
    return out.select(*[F.col(k).alias(c) for k, c in zip(ks, keys, strict=True)], "gt_count", "pr_count", "matched", ratio("pr_count").alias("obj_precision"), ratio("gt_count").alias("obj_recall"), f1.alias("obj_f1"))


def tiled_centre_dice(rows: DataFrame, *slice_cols: str, tile: int = 512, halo: int = 16) -> DataFrame:
    """slice, cldice as ``object_metrics`` has it, of slices of any size.

    Tiles see ``halo`` pixels of their neighbours. A pass looks one pixel far, so that half as many rounds of both passes leave
    the tile itself as it is in the whole slice; then borders are sent anew, until no tile changes. Only bits travel: a tile to itself,
    its borders to those beside it.
    """
    from tessavox.operators.lineage import cut

    if not 2 <= halo <= tile or halo % 2:
        raise ValueError("a halo is an even number of pixels, 2 or more, and not wider than a tile")
    keys = list(slice_cols or ("z",))
    ks = [f"k{i}_" for i in range(len(keys))]
    schema = ", ".join([*(f"{k} {kind(rows, c)}" for k, c in zip(ks, keys, strict=True)), "ty_ int, tx_ int, dy_ int, dx_ int, masks_ binary, lines_ binary, changed_ int"])
    sides = {-1: slice(0, halo), 0: slice(0, tile), 1: slice(tile - halo, tile)}  # of the sender, towards dy, dx
    places = {-1: slice(tile + halo, tile + 2 * halo), 0: slice(halo, tile + halo), 1: slice(0, halo)}  # in the canvas of who gets it

    def told(key: tuple, masks: bytes, lines: np.ndarray, changed: int) -> list[tuple]:
        *k, ty, tx = key
        out = [(*k, ty, tx, 0, 0, masks, np.packbits(lines).tobytes(), changed)]
        for dy, dx in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            part = lines[:, sides[dy], sides[dx]]
            if part.any():
                out.append((*k, ty + dy, tx + dx, dy, dx, None, np.packbits(part).tobytes(), 0))
        return out

    def first(*group) -> list[tuple]:
        *key, y, x, gt, pr = group
        masks = np.stack([grid(y - key[-2] * tile, x - key[-1] * tile, v > 0, "bool", (tile, tile)) for v in (gt, pr)])
        return told(tuple(key), np.packbits(masks).tobytes(), masks, 1) if masks.any() else []

    def again(groups: Iterator[tuple]) -> Iterator[tuple]:
        """Tiles thinned together, about STACK pixels at a time."""
        held: list[tuple] = []
        for *key, dys, dxs, masks, lines in groups:
            canvas, own = np.zeros((2, tile + 2 * halo, tile + 2 * halo), bool), None
            for dy, dx, mask, bits in zip(dys.tolist(), dxs.tolist(), masks, lines, strict=True):
                here = canvas[:, places[dy], places[dx]]
                here[:] = np.unpackbits(np.frombuffer(bits, np.uint8), count=here.size).reshape(here.shape)
                own = mask if (dy, dx) == (0, 0) else own
            if own is None:  # an empty tile
                continue
            held.append((tuple(key), own, canvas))
            if len(held) * canvas.size >= STACK:
                yield from thinner(held)
                held = []
        yield from thinner(held)

    def thinner(held: list[tuple]) -> Iterator[tuple]:
        if not held:
            return
        middle = (slice(None), slice(None), places[0], places[0])
        was = np.stack([c for _, _, c in held])
        new = thinned(was.reshape(-1, *was.shape[2:]), halo // 2).reshape(was.shape)[middle]
        changed = (new != was[middle]).any(axis=(1, 2, 3)).tolist()
        for (key, own, _), lines, moved in zip(held, new, changed, strict=True):
            yield from told(key, own, lines, int(moved))

    now = cut(worked(rows, [*[F.col(k) for k in keys], F.expr(f"CAST(y DIV {tile} AS INT)"), F.expr(f"CAST(x DIV {tile} AS INT)")], ["y", "x", "gt", "pr"], first, schema))
    by = [*[F.col(k) for k in ks], F.col("ty_"), F.col("tx_")]
    while not now.where("changed_ = 1").isEmpty():
        now = cut(worked_together(now, by, ["dy_", "dx_", "masks_", "lines_"], again, schema))

    def sums(*group) -> list[tuple]:
        *key, masks, lines = group
        out = np.zeros(6)
        for a, b in zip(masks, lines, strict=True):
            (gt, pr), (lg, lp) = (np.unpackbits(np.frombuffer(v, np.uint8), count=2 * tile * tile).reshape(2, -1) for v in (a, b))
            out += [gt.sum(), pr.sum(), lg.sum(), lp.sum(), (lg & pr).sum(), (lp & gt).sum()]
        return [(*key[: len(keys)], *map(int, out))]

    counts = ["gt_", "pr_", "lg_", "lp_", "lg_pr_", "lp_gt_"]
    each = worked(now.where("dy_ = 0 AND dx_ = 0"), by, ["masks_", "lines_"], sums, ", ".join([*schema.split(", ")[: len(keys)], *(f"{c} long" for c in counts)]))
    total = each.groupBy(*ks).agg(*[F.sum(c).alias(c) for c in counts])
    covered, found = F.col("lg_pr_") / (F.col("lg_") + 1e-6), F.col("lp_gt_") / (F.col("lp_") + 1e-6)
    score = F.when((F.col("gt_") > 0) & (F.col("pr_") > 0) & (covered + found > 0), 2 * covered * found / (covered + found)).otherwise(0.0)
    every = rows.select(*[F.col(c).alias(k) for k, c in zip(ks, keys, strict=True)]).distinct()
    return every.join(total, ks, "left").select(*[F.col(k).alias(c) for k, c in zip(ks, keys, strict=True)], F.coalesce(score, F.lit(0.0)).alias("cldice"))


def components(mask: DataFrame) -> DataFrame:
    """z, y, x, component of the foreground of a whole volume (26 neighbours): the smallest number of its voxels.

    For objects that cross slices and blocks: neighbours meet by equal joins, and the links are contracted by alternating
    large and small stars until nothing moves. Both hook whole trees onto smaller roots, so objects of any length end
    up with one label after a number of rounds that grows with the logarithm of their voxels.
    """
    from tessavox.operators.lineage import cut

    side = 1 << 20
    number = (F.col("z") * side + F.col("y")) * side + F.col("x")
    now = cut(mask.select("z", "y", "x", number.alias("id")))
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) < (0, 0, 0)]
    inside = [(F.col("y") + b).between(0, side - 1) & (F.col("x") + c).between(0, side - 1) for _, b, c in steps]  # else numbers run over into another row
    near = F.array_compact(F.array(*[F.when(ok, F.lit((a * side + b) * side + c).cast("long")) for ok, (a, b, c) in zip(inside, steps, strict=True)]))
    told = now.select(F.col("id").alias("a"), F.explode(near).alias("step")).select("a", (F.col("a") + F.col("step")).alias("b"))
    edges = cut(told.join(now.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))

    roots = _contracted(edges).select(F.col("a").alias("id"), F.col("b").alias("root"))
    return now.join(roots, "id", "left").select("z", "y", "x", F.coalesce("root", "id").alias("component"))
