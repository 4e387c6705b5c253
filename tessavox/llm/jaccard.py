"""Near-duplicates by the Jaccard similarity of word shingles: a grouped prefix join, exact for every link between different texts.

Shingles have one global order, rare ones first; any such order gives right results, so the counts behind it need only be about right
(shingles that a task meets repeatedly, summed over tasks, as many as fit in a table of fixed size). Two linked sets share a shingle
among the first ``n - ceil(t n) + 1`` of each. Equal sets are one node, nodes with the same size and prefix one group, and only groups
are posted under the shingles of their prefixes.

Groups of copies must not cost all their pairs. So, first, each posted group meets only a leader of its shingle (the one that has the
shingle earliest, of a size that fits): these pairs of groups are expanded to nodes, sieved, verified on the whole sets, and contracted.
Then the shingles that still hold several components give all pairs of groups from different components, but for stars whose leaders are
too far from each other; these pairs are filtered by how many shingles of their prefixes they share and what can follow, expanded,
sieved and verified likewise. Within a component nothing is left to find.

Pairs are sieved by sketches: a bit for each remainder of hashes, set if an odd number of the set's shingles has it. Two sketches differ in
no more bits than the sets in shingles, so no link is lost, and most pairs that aren't linked go without their sets being sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import pick, small, tidy, whole, written
from tessavox.llm.simhash import contracted

SHINGLE, PERCENT = 5, 80
#: Shingles that are counted together, shingles whose counts are kept (16 bytes each), and sets known at a time.
CHUNK, COUNTED, KNOWN = 1 << 21, 1 << 21, 1 << 19
#: Bytes of texts whose words are taken together, and of a word that is hashed alone; sets that one node is compared with in a task; groups of a large star.
PIECE, LONG, MEMBERS, LARGE = 1 << 18, 256, 2048, 16
#: Bits of the longest and of the shortest sketch of a set.
SKETCH, SHORTEST = 1 << 16, 1 << 8
_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_ODD[1])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_ODD[2])
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted 64-bit hashes of texts' different word shingles; fewer words than a shingle's are one, no words none."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def sets(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts' sets in order, PIECE bytes of texts (a longer text alone) at a time: sets one behind another, and their bounds."""
        texts = texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + PIECE, side="right")) - 1)
            part = data[ends[low] : ends[high]].to_pybytes() if ends[low] < ends[high] else b""
            yield self._sets(*self._words(part.translate(_WORDS), ends[low : high + 1] - ends[low]))
            low = high

    def of(self, text: str) -> np.ndarray:
        return next(self.sets(pa.array([text], pa.string())))[0]

    def _words(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes of texts that lie one behind another, and how many words each has."""
        if len(data) <= PIECE:
            return _hashes(data, bounds)
        out, at = [], 0
        while at < len(data):
            end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else len(data)
            end = len(data) if end < 0 else end
            out.append(_hashes(data[at:end], np.array([0, end - at]))[0])
            at = end
        w = np.concatenate(out)
        return w, np.array([len(w)])

    def _sets(self, w: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, first = self.size, np.concatenate([[0], np.cumsum(many)])
        counts = np.where(many < size, np.minimum(many, 1), many - size + 1)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], np.uint64)
        whole_ = np.repeat(many >= size, counts)
        text = np.repeat(np.arange(len(many), dtype=np.int32), many)
        if len(w) >= size:
            out[whole_] = _runs([w[k : len(w) - size + 1 + k] for k in range(size)])[text[: len(w) - size + 1] == text[size - 1 :]]
        for m in range(1, size):
            few = np.flatnonzero(many == m)
            if len(few):
                out[bounds[few]] = _runs([w[first[few] + k] for k in range(m)])
        for a, b in pairwise(bounds.tolist()):
            out[a:b].sort()
        kept = np.ones(len(out) + 1, bool)
        kept[1:-1] = out[1:] != out[:-1]
        kept[bounds] = True
        kept = kept[:-1]
        return out[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def _runs(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs of words: the first words' hashes, the second ones', and so on."""
    h = np.full(len(words[0]), (len(words) * _ODD[0]) % (1 << 64), np.uint64)
    for w in words:
        h = _mixed(h + w)
    return h


def _hashes(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words between spaces, eight bytes of all words at a time, and how many words stand between the bounds."""
    inside = np.frombuffer(data, np.uint8) != 32
    begins, stops, edges = inside.copy(), inside.copy(), bounds[bounds < len(data)]
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    left = np.flatnonzero(stops) + 1 - starts
    eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    h = _mixed(left.astype(np.uint64) + np.uint64(_ODD[0]))
    for k in np.flatnonzero(left > LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + left[k]], 1)
    live = np.flatnonzero(left <= LONG)
    at, left = starts[live], left[live]
    while len(live):
        h[live] = _mixed(h[live] + (eights[at] & _FIRST[np.minimum(left, 8)]))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    return h, np.diff(np.searchsorted(starts, bounds))


def least_overlap(n: int | np.ndarray, m: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The least intersection of linked sets of the sizes: ``100 i >= percent (n + m - i)``."""
    return -(-percent * (n + m) // (100 + percent))


def _node(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sketches(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each of the sets the parities of the shingles of each remainder, two bits or more a shingle (up to SKETCH bits)."""
    sizes = np.diff(bounds)
    bits = np.array([min(SKETCH, max(SHORTEST, 1 << (2 * n - 1).bit_length())) if n else 0 for n in sizes.tolist()], np.int64)
    at = np.concatenate([[0], np.cumsum(bits)])
    place = np.repeat(at[:-1], sizes) + (tokens & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=at[-1]) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [data[a:b] for a, b in pairwise((at >> 3).tolist())]


def _sketch(tokens: np.ndarray) -> bytes:
    return _sketches(tokens, np.array([0, len(tokens)]))[0]


def _differing(a: bytes, b: bytes) -> int:
    """A lower bound of how many shingles are in one of two sets only, from their sketches; the longer one is folded."""
    short, long = (a, b) if len(a) < len(b) else (b, a)
    one, other, bits = int.from_bytes(short, "little"), int.from_bytes(long, "little"), 8 * len(long)
    while bits > 8 * len(short):
        bits >>= 1
        other = (other >> bits) ^ (other & ((1 << bits) - 1))
    return (one ^ other).bit_count()


def _folded(sketch: str) -> Column:
    """A column of sketches, each as one of SHORTEST bits."""

    @F.arrow_udf("array<long>")
    def fold(sketches: pa.Array) -> pa.Array:
        return pa.array([np.bitwise_xor.reduce(np.frombuffer(s, "<i8").reshape(-1, SHORTEST // 64), axis=0).tolist() for s in sketches.to_pylist()], pa.list_(pa.int64()))

    return fold(sketch)


def _sieved(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of those pairs of nodes, of the sizes n and n_2, that their sketches allow to be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy() for i in (2, 3))
            most = n + m - 2 * least_overlap(n, m, percent)
            apart = np.fromiter(map(_differing, b.column(4).to_pylist(), b.column(5).to_pylist()), np.int64, b.num_rows)
            yield b.select([0, 1]).filter(pa.array(apart <= most))

    return pairs.select("a", "b", "n", "n_2", "sketch", "sketch_2").mapInArrow(run, "a binary, b binary")


def _far(stars: DataFrame) -> DataFrame:
    """hub, hub_2, r, r_2 of pairs of leaders and ``least``, a lower bound of their Jaccard distance, from their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy() for i in (4, 5))
            apart = np.fromiter(map(_differing, b.column(6).to_pylist(), b.column(7).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(2 * apart / (n + m + apart))], ["hub", "hub_2", "r", "r_2", "least"])

    columns = ["hub", "hub_2", "r", "r_2", "n", "n_2", "sketch", "sketch_2"]
    return stars.select(*columns).mapInArrow(run, "hub binary, hub_2 binary, r double, r_2 double, least double")


def _repeated(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that tasks meet in several different sets, and how often: at most COUNTED, the most frequent ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, some, n = Shingles(size), set(), [], 0

        def out() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(some), return_counts=True)
            often = times > 1
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(times[often])], ["token", "n"])

        for b in batches:
            for tokens, bounds in shingles.sets(b.column(0)):
                new = np.zeros(len(bounds) - 1, bool)
                for k, (low, high) in enumerate(pairwise(bounds.tolist())):
                    if low < high and (node := xxhash.xxh64_intdigest(tokens[low:high])) not in seen:
                        if len(seen) > KNOWN:
                            seen.clear()
                        seen.add(node)
                        new[k] = True
                fresh = tokens[np.repeat(new, np.diff(bounds))]
                some.append(fresh)
                n += len(fresh)
                if n >= CHUNK:
                    yield out()
                    some, n = [], 0
        if n:
            yield out()

    counts = written(texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    by = counts.groupBy("n").count().toArrow()
    n, many = by.column("n").to_numpy(), by.column("count").to_numpy()
    order = np.argsort(-n)
    fits = order[np.cumsum(many[order]) <= COUNTED]
    kept = counts.where(F.col("n") >= int(n[fits].min()) if len(fits) else F.lit(False)).toArrow()
    token = kept.column("token").to_numpy().view(np.uint64)
    at = np.argsort(token)
    return token[at], np.minimum(kept.column("n").to_numpy()[at], (1 << 31) - 1).astype(np.int32)


class Times:
    """How often shingles were counted; a table of their first bits tells where in the sorted ones to look."""

    def __init__(self, token: np.ndarray, times: np.ndarray):
        bits = max(1, len(token).bit_length())
        self.token, self.times, self.shift = token, times, np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((token >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int32)
        bucket = (s >> self.shift).astype(np.int64)
        at, end, live = self.first[bucket], self.first[bucket + 1], np.arange(len(s))
        on = at < end
        while on.any():
            at, end, live, s = at[on], end[on], live[on], s[on]
            token = self.token[at]
            hit = token == s
            out[live[hit]] = self.times[at[hit]]
            at += 1
            on = (token < s) & (at < end)
        return out


def _rows(texts: DataFrame, counts: Broadcast, size: int, percent: int) -> DataFrame:
    """doc_id, key (of the text), n, node (of the set), grp (of size and prefix) of every row; the sketch and the prefix where the task
    meets the node and the group first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, shingles, seen, sketched = Times(*counts.value), Shingles(size), set(), set()
        for b in batches:
            done = 0
            for tokens, bounds in shingles.sets(b.column(2)):
                nodes, groups, prefixes, sketches = [], [], [], _sketches(tokens, bounds)
                ranks = times.of(tokens)
                for k, (low, high) in enumerate(pairwise(bounds.tolist())):
                    if low == high:
                        nodes.append(None)
                        groups.append(None)
                        prefixes.append(None)
                        sketches[k] = None
                        continue
                    s = tokens[low:high]
                    node = _node(s)
                    nodes.append(node)
                    if len(sketched) > KNOWN:
                        sketched.clear()
                    if node in sketched:
                        sketches[k] = None
                    sketched.add(node)
                    first = s[np.argsort(ranks[low:high], kind="stable")[: len(s) + percent * len(s) // -100 + 1]]
                    group = xxhash.xxh64_intdigest(first.tobytes(), len(s)) - (1 << 63)
                    groups.append(group)
                    if group in seen:
                        prefixes.append(None)
                        continue
                    if len(seen) > KNOWN:
                        seen.clear()
                    seen.add(group)
                    prefixes.append(first.view(np.int64))
                own = b.slice(done, len(nodes))
                done += len(nodes)
                columns = [pa.array(np.diff(bounds), pa.int64()), pa.array(nodes, pa.binary()), pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *columns], ["doc_id", "key", "n", "node", "grp", "prefix", "sketch"])

    return texts.mapInArrow(run, "doc_id long, key long, n long, node binary, grp long, prefix array<long>, sketch binary")


def _posted(rows: DataFrame, percent: int) -> DataFrame:
    """token, grp, n, pos of the groups that share a shingle of their prefixes with others, and the leader that each one meets.

    Dealt by ranges of (shingle, place), so a frequent shingle lies in several partitions, with leaders in each.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = current = held = None
        leaders: list[tuple[int, int]] = []

        def led(kept: np.ndarray) -> pa.RecordBatch:
            nonlocal current, leaders
            out: list[int | None] = []
            for token, group, n in zip(kept[0].tolist(), kept[1].tolist(), kept[2].tolist(), strict=True):
                if token != current:
                    current, leaders = token, []
                mine = next((g for g, m in leaders if 100 * min(n, m) >= percent * max(n, m)), None)
                if mine is None:
                    leaders.append((group, n))
                out.append(None if mine == group else mine)
            return pa.RecordBatch.from_arrays([*map(pa.array, kept), pa.array(out, pa.int64())], ["token", "grp", "n", "pos", "leader"])

        for b in batches:
            if not b.num_rows:
                continue
            now = np.stack([c.to_numpy() for c in b.columns])
            alone = True  # whether the row held back is the only one of its shingle so far
            if held is not None:
                now, alone = np.concatenate([held[0], now], axis=1), held[1]
            again = np.concatenate([[False], (now[:2, 1:] == now[:2, :-1]).all(axis=0)])  # posted by several tasks
            now = now[:, ~again]
            token = now[0]
            first = token[0] if first is None else first
            same = token[1:] == token[:-1]
            before, after = np.concatenate([[not alone], same]), np.concatenate([same, [False]])
            held = now[:, -1:], not before[-1]
            kept = (before | after | (token == first))[:-1]
            if kept.any():
                yield led(now[:, :-1][:, kept])
        if held is not None:
            yield led(held[0])  # the shingle may go on in the next partition

    posts = rows.where("prefix is not null").select("grp", F.col("n"), F.posexplode("prefix").alias("pos", "token")).select("token", "grp", "n", F.col("pos").cast("long").alias("pos"))
    order = ["token", "pos", "n", "grp"]
    return posts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lead, "token long, grp long, n long, pos long, leader long")


def _compared(pairs: DataFrame, members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, far (their Jaccard distance), linked of pairs of nodes, from the whole sets.

    Each text is read once and its set sent to every pair that it is in: to the parts of MEMBERS rows that a node a is compared in,
    first a itself, then a stream of the others.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    others = pairs.join(parts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(False).alias("head"))
    heads = parts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("head"))
    sends = others.union(heads).groupBy("node").agg(F.collect_list(F.struct("a", "part", "head")).alias("to"))
    wanted = written(sends.join(members, "node").select(F.col("at.key").alias("key_"), F.col("at.doc_id").alias("id_"), "to"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, names = Shingles(size), ["a", "part", "head", "node", "tokens"]
        out, held = [], 0
        for b in batches:
            found = (tokens[low:high] for tokens, bounds in shingles.sets(b.column(0)) for low, high in pairwise(bounds.tolist()))
            for s, to in zip(found, b.column(1).to_pylist(), strict=True):
                node, data = _node(s), s.tobytes()
                for x in to:
                    out.append((x["a"], x["part"], x["head"], node, data))
                    held += len(data)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = s = None
        for b in batches:
            out = []
            for a, head, node, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                t = np.frombuffer(tokens.as_buffer(), np.uint64)
                if head:
                    first, s = a, t.copy()
                    continue
                assert first == a
                short, long = (s, t) if len(s) < len(t) else (t, s)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                common = int((long[at] == short).sum())
                union = len(s) + len(t) - common
                out.append((a, node, 1 - common / union, 100 * common >= percent * union))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.binary(), pa.binary(), pa.float64(), pa.bool_()], strict=True)], ["a", "b", "far", "linked"])

    kinds = [pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    here = (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_"))
    sent = texts.join(small(wanted), here).select("text", "to").mapInArrow(sets, "a binary, part int, head boolean, node binary, tokens binary")
    dealt = sent.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("head"))
    return dealt.select("a", "head", "node", "tokens").mapInArrow(compare, "a binary, b binary, far double, linked boolean").distinct()


def _met() -> list[Column]:
    return [F.count("*").alias("common"), F.max("at_g").alias("at_g"), F.max("at_h").alias("at_h")]


_ENOUGH = "{q} * (common + least(n_g - at_g, n_h - at_h) - 1) >= {p} * (n_g + n_h)"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) of every row.

    Rows with a null id take part; their component's id is that of its smallest id, null if it has none. Null, empty and wordless
    texts have no shingles and are linked with nothing. Repeated rows get equal results. Texts may be of any length, tables may be
    empty, extra columns are ignored.
    """
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole("text")).alias("key"), whole("text").alias("text"))
    with tidy(spark):
        counted = _repeated(texts, size)
        counts = spark.sparkContext.broadcast(counted)
        rows = written(_rows(texts, counts, size, percent), "rows", last=True)
        counts.destroy()
        posted = written(_posted(rows, percent), "posted")
        first = F.first("sketch", ignorenulls=True).alias("sketch")
        members = written(rows.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("grp").alias("grp"), F.min(F.struct("key", "doc_id")).alias("at"), first), "members")
        heads = members.groupBy("grp").agg(F.min(F.struct("node", "n", "sketch")).alias("head"))
        heads = heads.select(F.col("grp").alias("g"), F.col("head.node").alias("a"), F.col("head.n").alias("n"), F.col("head.sketch").alias("sketch"))
        others = members.select("grp", F.col("node").alias("b"), F.col("n").alias("n_2"), F.col("sketch").alias("sketch_2"))
        stars = posted.where("leader is not null").select(F.col("leader").alias("g"), "grp").distinct().join(others, "grp").join(heads, "g")
        inside = others.join(heads, F.col("grp") == F.col("g")).where("a != b")
        pairs = _sieved(stars, percent).union(_sieved(inside, percent))
        met = written(_compared(written(pairs, "stars"), members, texts, size, percent), "met")
        links = met.where("linked").select("a", "b")
        groups = written(_components(links), "groups")
        # who is linked with a leader stands at a known distance from it
        hubs = met.where("linked").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("far", "a")).alias("hub"))
        units = members.join(groups, "node", "left").join(hubs, "node", "left")
        units = written(units.select("grp", "node", "n", "sketch", F.coalesce("root", "node").alias("root"), F.coalesce("hub.a", "node").alias("hub"), F.coalesce("hub.far", F.lit(0.0)).alias("far")), "units")
        late = _across(posted, units, members, texts, size, percent)
        if not late.isEmpty():
            groups = written(_components(links.union(late)), "groups")
        ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        named = ids.join(groups, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        least = named.groupBy("root").agg(F.min("least").alias("component"))
        grouped = written(named.join(least, "root").select(F.col("node").alias("g"), "component"), "grouped", last=True)
    return rows.join(grouped, F.col("node") == F.col("g"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def _components(links: DataFrame) -> DataFrame:
    """node, root of all linked nodes, roots included."""
    groups = contracted(links)
    return groups.union(groups.select("root", "root")).distinct()


def _guests(posts: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """g, h, hub, hub_2: pairs of groups, filtered by the shingles that they share, of a large star and of others.

    A part of the large star is held by shingle, the others' groups pass by one at a time: rows in proportion to both, not to their pairs.
    """
    first = F.col("many") >= F.col("many_2")
    told = blocks.select(F.when(first, F.col("hub")).otherwise(F.col("hub_2")).alias("host"), F.when(first, F.col("hub_2")).otherwise(F.col("hub")).alias("guest"), F.greatest("many", "many_2").alias("many"), F.least("many", "many_2").alias("few"))
    hosts = told.groupBy("host").agg(F.ceil(F.max("many") / MEMBERS).cast("int").alias("parts"), F.ceil(F.sum("few") / (16 * MEMBERS)).cast("int").alias("lanes"))
    plain = posts.select(F.col("hub").alias("star"), "grp", "n", "token", "pos")
    part, lane = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))
    own = hosts.join(plain, F.col("host") == F.col("star")).withColumn("part", F.pmod(F.xxhash64("grp"), "parts").cast("int")).select("host", "part", lane.alias("lane"), F.lit(0).alias("kind"), "star", "grp", "n", "token", "pos")
    guests = told.join(hosts, "host").join(plain, F.col("guest") == F.col("star")).withColumn("lane", F.pmod(F.xxhash64("grp"), "lanes").cast("int")).select("host", part.alias("part"), "lane", F.lit(1).alias("kind"), "star", "grp", "n", "token", "pos")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, index = None, [], None

        def indexed() -> tuple[np.ndarray, ...]:
            group, n, token, pos = (np.array(x, np.int64) for x in zip(*held, strict=True))
            groups, number = np.unique(group, return_inverse=True)
            sizes = np.zeros(len(groups), np.int64)
            sizes[number] = n
            by = np.argsort(token, kind="stable")
            return groups, sizes, token[by], number[by], pos[by]

        def guest(rows: list[tuple]) -> np.ndarray:
            groups, sizes, token, number, at = index
            own = np.array([r[2] for r in rows], np.int64)
            low, high = np.searchsorted(token, own), np.searchsorted(token, own, side="right")
            common, last, own_last = (np.zeros(len(groups), np.int64) for _ in range(3))
            for a, b, r in zip(low.tolist(), high.tolist(), rows, strict=True):
                who = number[a:b]
                common[who] += 1
                last[who] = np.maximum(last[who], at[a:b])
                own_last[who] = np.maximum(own_last[who], r[3])
            n = rows[0][1]
            fits = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & ((100 + percent) * (common + np.minimum(sizes - last, n - own_last) - 1) >= percent * (sizes + n))
            return groups[fits & (common > 0)]

        waiting: tuple | None = None  # place, star, group of the guest whose rows are being gathered
        rows: list[tuple] = []
        for b in batches:
            out: list[tuple] = []

            def leave() -> None:
                if waiting is not None:
                    out.extend((g, waiting[2], waiting[0][0], waiting[1]) for g in guest(rows).tolist())  # noqa: B023

            for host, part, lane, kind, star, grp, n, token, pos in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (host, part, lane) != place:
                    leave()
                    place, held, index, waiting, rows = (host, part, lane), [], None, None, []
                if kind == 0:
                    held.append((grp, n, token, pos))
                    continue
                if not held:
                    continue
                if index is None:
                    index = indexed()
                if waiting is None or waiting[1:] != (star, grp):
                    leave()
                    waiting, rows = (place, star, grp), []
                rows.append((grp, n, token, pos))
            if out:
                yield _guest_rows(out)
        if waiting is not None:
            yield _guest_rows([(g, waiting[2], waiting[0][0], waiting[1]) for g in guest(rows).tolist()])

    dealt = own.union(guests).repartition("host", "part", "lane").sortWithinPartitions("host", "part", "lane", "kind", "star", "grp")
    return dealt.mapInArrow(meet, "g long, h long, hub binary, hub_2 binary")


def _guest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["g", "h", "hub", "hub_2"])


def _across(posted: DataFrame, units: DataFrame, members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: the links between nodes of different components.

    Stars meet first: if the distance of their leaders is beyond the threshold and both stars' radii (the triangle inequality holds for
    Jaccard distances), no two of their members are linked. The others meet group by group.
    """
    posts = posted.select("token", "grp", "n", "pos").join(units.select("grp", "root", "hub").distinct(), "grp")
    open_ = posts.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    posts = written(posts.join(open_, "token").distinct(), "open")
    radius = units.groupBy("hub").agg(F.max("far").alias("r")).join(members.select(F.col("node").alias("hub"), "n", "sketch"), "hub")
    leaders = written(radius.select("hub", "r", F.col("n").alias("size"), _folded("sketch").alias("bits")), "leaders")
    # sizes and places that a star has a shingle in: what can be shared, over all its groups
    held = posts.groupBy("token", "root", "hub").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max("pos").alias("before"), F.max(F.col("n") - F.col("pos")).alias("after")).join(leaders, "hub")
    other = held.select("token", F.col("root").alias("other"), *[F.col(c).alias(f"{c}_2") for c in ("hub", "n", "most", "before", "after", "r", "size", "bits")])
    fit = f"100 * most >= {percent} * n_2 AND 100 * most_2 >= {percent} * n AND {100 + percent} * (least(before, before_2) + least(after, after_2)) >= {percent} * (n + n_2)"
    beyond = f"{{}} > 1 - {percent} / 100D + r + r_2 + 1e-9"
    # the leaders' short sketches already tell most stars of near misses apart, before they become a row for each shared shingle
    apart = " + ".join(f"bit_count(bits[{i}] ^ bits_2[{i}])" for i in range(SHORTEST // 64))
    fit += f" AND NOT {beyond.format(f'2D * ({apart}) / (size + size_2 + {apart})')}"
    both = written(held.join(other, "token").where(f"root < other AND {fit}").select("token", "hub", "hub_2"), "both")
    second = radius.select(F.col("hub").alias("hub_2"), F.col("r").alias("r_2"), F.col("n").alias("n_2"), F.col("sketch").alias("sketch_2"))
    stars = written(_far(both.select("hub", "hub_2").distinct().join(radius, "hub").join(second, "hub_2")), "stars")
    near = stars.where("r + r_2 > 0 AND NOT " + beyond.format("least"))
    met = written(_compared(near.select(F.col("hub").alias("a"), F.col("hub_2").alias("b")), members, texts, size, percent), "met")
    apart = met.join(near, (F.col("a") == F.col("hub")) & (F.col("b") == F.col("hub_2"))).where(beyond.format("far"))
    apart = apart.select("hub", "hub_2").union(stars.where(beyond.format("least")).select("hub", "hub_2"))
    both = both.join(apart, ["hub", "hub_2"], "left_anti")
    many = posts.groupBy("hub").agg(F.count_distinct("grp").alias("many"))
    sized = both.select("hub", "hub_2").distinct().join(many, "hub").join(many.select(F.col("hub").alias("hub_2"), F.col("many").alias("many_2")), "hub_2")
    blocks = written(sized.where(f"greatest(many, many_2) >= {LARGE}"), "blocks")
    both = both.join(blocks.select("hub", "hub_2"), ["hub", "hub_2"], "left_anti")
    one = posts.select("token", "hub", F.col("grp").alias("g"), F.col("n").alias("n_g"), F.col("pos").alias("at_g"))
    two = posts.select("token", F.col("hub").alias("hub_2"), F.col("grp").alias("h"), F.col("n").alias("n_h"), F.col("pos").alias("at_h"))
    close = f"100 * least(n_g, n_h) >= {percent} * greatest(n_g, n_h) AND {100 + percent} * (least(at_g, at_h) + least(n_g - at_g, n_h - at_h)) >= {percent} * (n_g + n_h)"
    shared = both.join(one, ["token", "hub"]).join(two, ["token", "hub_2"]).where(close)
    shared = shared.groupBy("g", "h", "hub", "hub_2", "n_g", "n_h").agg(*_met()).where(_ENOUGH.format(p=percent, q=100 + percent))
    shared = shared.select("g", "h", "hub", "hub_2").union(_guests(posts, blocks, percent))
    g_side = units.select(F.col("grp").alias("g"), "hub", F.col("node").alias("a"), "n", "sketch")
    h_side = units.select(F.col("grp").alias("h"), F.col("hub").alias("hub_2"), F.col("node").alias("b"), F.col("n").alias("n_2"), F.col("sketch").alias("sketch_2"))
    pairs = written(_sieved(shared.join(g_side, ["g", "hub"]).join(h_side, ["h", "hub_2"]), percent).distinct(), "across")
    links = met if pairs.isEmpty() else met.union(_compared(pairs, members, texts, size, percent))
    return written(links.where("linked").select("a", "b"), "links")
