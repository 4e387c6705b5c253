"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees, then groups of linked texts.

Different fingerprints, not documents, are searched. The top of a tree is grown on a sample of some fingerprints for each
shard: each node splits by the distance to its vantage point, chosen so that few points lie near the border. A fingerprint lives in one leaf, its shard, and is also sent as a query to every
other shard that its ball of the radius reaches (the triangle inequality prunes the rest). Inside a shard a tree
over all its fingerprints is built and searched with the same bounds. A shard returns a forest of links, not all
pairs, so a dense group costs no more rows than it has members; the forests are joined into groups by star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import drop, pick, texts, tidy, whole, written

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
#: About how many fingerprints a shard holds (2 MB), or fewer where that leaves less than LEAST shards; fingerprints of the sample for
#: each shard; vantage points that a node of the top tree is chosen from; points of a leaf inside a shard.
SHARD, LEAST, SAMPLE, CHOICE, LEAF = 262_144, 16, 64, 16, 128
#: Least fingerprints of a shard.
SHARD_LEAST = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # bounded memory for long texts
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (tells rows with equal ids apart), fp (a long with the fingerprint's bits) of every row."""

    @F.arrow_udf("long")
    def fp(batch: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64))

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole("text")).alias("row_key"), fp(whole("text")).alias("fp"))


def vantage_of(points: np.ndarray, radius: int) -> tuple[np.uint64, int, np.ndarray]:
    """The vantage point, border and inner points of the best split: balanced, with few points that a ball reaches over the border."""
    best = None
    for vantage in points[:: max(1, len(points) // CHOICE)][:CHOICE]:
        d = np.bitwise_count(points ^ vantage)
        middle = int(np.median(d))
        for border in (middle - 1, middle):
            inner = d <= border
            share = float(inner.mean())
            near = float(np.mean((d > border - radius) & (d <= border + radius)))
            if 0 < share < 1:
                loss = near / -(share * np.log2(share) + (1 - share) * np.log2(1 - share))
                if best is None or loss < best[0]:
                    best = loss, vantage, border, inner
    return best[1:] if best else (points[0], 64, np.ones(len(points), bool))


class Node:
    """A node of the top tree; leaves carry their shard's number."""

    def __init__(self, points: np.ndarray, leaves: int, numbers: Iterator[int], radius: int = RADIUS):
        self.shard = -1
        if leaves > 1 and len(points) > 1:
            self.vantage, self.radius, inner = vantage_of(points, radius)
            if not inner.all():
                less = min(leaves - 1, max(1, round(leaves * float(inner.mean()))))
                self.inner = Node(points[inner], less, numbers, radius)
                self.outer = Node(points[~inner], leaves - less, numbers, radius)
                return
        self.shard = next(numbers)

    def home(self, fp: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        if self.shard >= 0:
            out[at] = self.shard
        elif len(at):
            inner = np.bitwise_count(fp[at] ^ self.vantage) <= self.radius
            self.inner.home(fp, at[inner], out)
            self.outer.home(fp, at[~inner], out)

    def reached(self, fp: np.ndarray, at: np.ndarray, radius: int, out: list[tuple[int, np.ndarray]]) -> None:
        if not len(at):
            return
        if self.shard >= 0:
            out.append((self.shard, at))
            return
        d = np.bitwise_count(fp[at] ^ self.vantage).astype(np.int64)
        self.inner.reached(fp, at[d - radius <= self.radius], radius, out)
        self.outer.reached(fp, at[d + radius > self.radius], radius, out)


class Forest:
    """Groups of row numbers under links that come in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def search_tree(points: np.ndarray, queries: np.ndarray, fp: np.ndarray, radius: int, forest: Forest, leaf: int = LEAF) -> None:
    """Link all pairs of a query and a point (row numbers of fp) within the radius: one branch of the tree."""
    if not len(points) or not len(queries):
        return
    if len(points) > leaf:
        vantage = fp[points[len(points) // 2]]
        d = np.bitwise_count(fp[points] ^ vantage).astype(np.int64)
        middle = int(np.median(d))
        inner = d <= middle
        if inner.all():
            middle -= 1
            inner = d <= middle
        if inner.any():
            q = np.bitwise_count(fp[queries] ^ vantage).astype(np.int64)
            search_tree(points[inner], queries[q - radius <= middle], fp, radius, forest, leaf)
            search_tree(points[~inner], queries[q + radius > middle], fp, radius, forest, leaf)
            return
    for i in range(0, len(points), 4096):
        some = points[i : i + 4096]
        step = max(1, (1 << 20) // len(some))
        for j in range(0, len(queries), step):
            q = queries[j : j + step]
            a, b = np.nonzero(np.bitwise_count(fp[q][:, None] ^ fp[some][None, :]) <= radius)
            forest.link(q[a], some[b])


def shards_of(n: int, shard: int = SHARD, least: int = LEAST) -> int:
    """Number of shards for n fingerprints."""
    return max(1, math.ceil(n / shard), min(least, n // SHARD_LEAST))


def _links(nodes: DataFrame, n: int, radius: int, sample: int, shards: int) -> DataFrame:
    """a, b: a forest over different fingerprints that links exactly those within the radius of each other."""
    # some fingerprints for each shard, the same for the same table: eight bytes each
    some = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample * shards).toArrow().column(0).to_numpy().view(np.uint64)
    tree = Node(some, shards, iter(range(1 << 30)), radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            home, out, every = np.zeros(len(fp), np.int64), [], np.arange(len(fp))
            tree.home(fp, every, home)
            tree.reached(fp, every, radius, out)
            for number, at in out:
                own = home[at]
                at, own = at[own <= number], own[own <= number]  # of two shards only the later is asked
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(fp[at].view(np.int64)), pa.array(own != number)], ["shard", "fp", "asks"])

    def search(t: pa.Table) -> pa.Table:
        fp, asks = t.column("fp").to_numpy().view(np.uint64), t.column("asks").to_numpy()
        forest = Forest(len(fp))
        search_tree(np.flatnonzero(~asks), np.arange(len(fp)), fp, radius, forest)
        linked = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pa.table({"a": fp[linked].view(np.int64), "b": fp[forest.root[linked]].view(np.int64)})

    return nodes.select("fp").mapInArrow(route, "shard int, fp long, asks boolean").groupBy("shard").applyInArrow(search, "a long, b long")


def contracted(links: DataFrame) -> DataFrame:
    """node, root of every linked node, by alternating large and small stars.

    Each round is written to the shared folder, and the one before removed.
    """
    spark = links.sparkSession

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def turn(edges: DataFrame) -> DataFrame:
        with tidy(spark):
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
            large = both.join(least, F.col("a") == F.col("u")).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = written(large.distinct(), "links")
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            return written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links", last=True)

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    was = state(edges)
    while was[0]:
        before, edges = edges, turn(edges)
        drop(before)
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, sample: int = SAMPLE, shards: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links), row_key of every row.

    Documents with the same fingerprint are one node. Null, empty and wordless texts have fingerprint
    zero and link like any other. Rows with a null id take part; their group's id is that of its
    smallest id, null if it has none. Repeated rows get equal results. Extra columns are ignored.
    """
    with tidy(docs.sparkSession):
        rows = written(fingerprints(docs, id_col, text_col), "fingerprints", last=True)
        nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
        n = nodes.count()
        groups = contracted(_links(nodes, n, radius, sample, shards or shards_of(n)))
        members = groups.union(groups.select("root", "root")).distinct()
        least = members.join(nodes, members.node == nodes.fp).groupBy("root").agg(F.min("least").alias("component"))
        linked = members.join(least, "root").select(F.col("node").alias("fp"), "component")
        alone = nodes.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component"))
        grouped = written(linked.union(alone), "groups", last=True).select(F.col("fp").alias("g"), "component")
    return rows.join(grouped, rows.fp == grouped.g, "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        "row_key",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, of each group only the one with the smallest id.

    Of rows that repeat an id one stays. Rows without an id can't be told apart and all stay.
    """
    with tidy(docs.sparkSession):
        found = written(near_duplicates(docs, id_col, text_col, **options).where("doc_id is null or doc_id = component_id").select("doc_id", "row_key"), "kept", last=True)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))])
    key = F.col(f"c{id_at}_").cast("long")
    named = found.where("doc_id is not null")
    kept = named.distinct()
    out = plain.join(kept, (key == kept.doc_id) & (F.xxhash64(whole(f"c{text_at}_")) == kept.row_key), "left_semi")
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([f"c{id_at}_"])
    if not found.where("doc_id is null").isEmpty():
        out = out.union(plain.where(key.isNull()))
    return out.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)])
