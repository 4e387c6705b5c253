"""Resampling of a corpus towards a target's distribution by hashed n-gram importance weights.

Counts of hashed features of the corpus and the target make one array of gains, of fixed length; a document's weight is an array
lookup per feature. Weights with Gumbel noise are scores, and the highest scores are a draw without replacement in proportion to
the weights. Scored documents are written as sorted runs, one for each partition. A histogram over the scores (integers, so of
bounded size) says where the exact draw count falls and cuts the scores in ranges of a known number of rows and a known first rank;
each range merges its slices of all runs by a tournament tree and stops when the draw is full.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import pick, tidy, whole, written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Most rows of a range (but for rows of one score), and how many ranges there are at least where that leaves LEAST_RANGE rows or more.
RANGE, RANGES, LEAST_RANGE = 262_144, 32, 1024
#: Words whose hashes are known at a time, bytes of a text and words of several texts that are taken together.
KNOWN, PIECE, TOGETHER = 1 << 19, 1 << 20, 1 << 17
#: Lower case, everything between words a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _zeros(longest: int) -> np.ndarray:
    """[n, k, b]: what byte k of a CRC-32, of value b, becomes when n zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(longest):
        now = (now >> 8) ^ step[now & 255]
        out.append(now)
    return np.stack(out)


#: Longer words are hashed one by one.
_LONGEST = 63
_ZEROS = _zeros(_LONGEST + 1)


class Features:
    """Hashed runs of one and two words of many texts."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.alone, self.after, self.length = array("I"), array("I"), array("H")

    def _ids(self, words: list[bytes]) -> list[int]:
        try:
            return [*map(self.known.__getitem__, words)]
        except KeyError:
            pass
        for w in dict.fromkeys(words):
            if w not in self.known:
                self.known[w] = len(self.words)
                self.words.append(w)
                self.alone.append(zlib.crc32(w))
                self.after.append(zlib.crc32(b" " + w))
                self.length.append(min(len(w) + 1, 0xFFFF))
        return [*map(self.known.__getitem__, words)]

    def _hashed(self, ids: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 of the words, and of those pairs that end at the marked words."""
        alone = np.frombuffer(self.alone, np.uint32)[ids]
        ends = np.flatnonzero(pair)
        second = ids[ends]
        first, length = alone[ends - 1], np.frombuffer(self.length, np.uint16)[second].astype(np.int64)
        long = np.flatnonzero(length > _LONGEST)
        length[long] = 0
        both = np.frombuffer(self.after, np.uint32)[second]
        for k in range(4):
            both = both ^ _ZEROS[length, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        for i in long.tolist():
            both[i] = zlib.crc32(b" " + self.words[second[i]], int(first[i]))
        return alone, both

    def of(self, texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text number of each word, then text number and bucket of each feature, for some texts or part of a long one at a time."""
        ids: list[int] = []
        owner: list[tuple[int, int]] = []  # text, number of its words here
        carried = False  # the first word was counted before and stands here for its pair only

        def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.array(ids, np.int64)
            text = np.repeat(np.array([t for t, _ in owner], np.int64), [n for _, n in owner])
            pair = np.zeros(len(at), bool)
            pair[1:] = text[1:] == text[:-1]
            alone, both = self._hashed(at, pair)
            of_pairs = text[pair]
            if carried:
                alone, text = alone[1:], text[1:]
            return text, np.concatenate([text, of_pairs]), np.concatenate([alone, both]) % np.uint32(self.buckets)

        for number, line in enumerate(texts):
            data, at = line.encode().translate(_WORDS), 0
            while at < len(data):
                end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else len(data)
                end = len(data) if end < 0 else end
                found = data[at:end].split()
                at = end
                if not found:
                    continue
                ids += self._ids(found)
                owner.append((number, len(found)))
                if len(ids) >= TOGETHER:
                    yield flush()
                    last = self.words[ids[-1]]
                    if len(self.words) > KNOWN:
                        self._clear()
                    # the next piece of this text pairs with its last word
                    ids, owner, carried = ([*self._ids([last])], [(number, 1)], True) if at < len(data) else ([], [], False)
        if len(ids) > carried:
            yield flush()


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, bucket in features.of(b.column(0).to_pylist()):
                sums += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    found = texts.select(whole("text").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share of the target over that of the corpus, floored."""
    n = len(corpus)
    s_all, t_all = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str) -> int:
    """Gumbel noise of a document, from the first 32 bits of a digest."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class Tournament:
    """A tree of losers over sorted runs: each pop gives the least head's run and costs a match for each level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.heads = [(0, *r[0]) if r else (1,) for r in runs]
        self.losers = [0] * self.k
        self.winner = self._grow(1) if self.k > 1 else 0

    def _grow(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._grow(2 * node), self._grow(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def pop(self) -> tuple[int, int]:
        """Run and place in it of the least row that is left."""
        run = self.winner
        place = self.at[run]
        self.at[run] = place + 1
        self.heads[run] = (0, *self.runs[run][place + 1]) if place + 1 < len(self.runs[run]) else (1,)
        best, node = run, (run + self.k) // 2
        while node:
            if self.heads[self.losers[node]] < self.heads[best]:
                best, self.losers[node] = self.losers[node], best
            node //= 2
        self.winner = best
        return run, place


def merged(score: np.ndarray, ids: np.ndarray, take: int) -> np.ndarray:
    """Row numbers of the first rows by score (high to low), then id: a merge of the sorted runs that the rows come in."""
    if not len(score):
        return np.zeros(0, np.int64)
    falls = (score[1:] > score[:-1]) | ((score[1:] == score[:-1]) & (ids[1:] < ids[:-1]))
    starts = np.concatenate([[0], np.flatnonzero(falls) + 1])
    keys = list(zip((-score).tolist(), ids.tolist(), strict=True))
    tree = Tournament([keys[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)])
    return np.array([starts[r] + p for r, p in (tree.pop() for _ in range(min(take, len(keys))))], np.int64)


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, eligible of every row."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    gain = gains(_counts(rows, buckets), _counts(pick(target, text=target_col), buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for b in batches:
            n = b.num_rows
            words, many, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for word, text, bucket in features.of(b.column(1).to_pylist()):
                words += np.bincount(word, minlength=n)
                many += np.bincount(text, minlength=n)
                sums += np.bincount(text, weights=gain[bucket], minlength=n).astype(np.int64)
            weight = np.where(many > 0, sums // np.maximum(many, 1), 0)
            noises = [noise(f"{seed}:{'' if i is None else i}") for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(many), pa.array(weight), pa.array(weight + np.array(noises, np.int64)), pa.array(words >= least_words)], ["doc_id", "n_features", "weight", "score", "eligible"])

    return rows.mapInArrow(score, "doc_id long, n_features long, weight long, score long, eligible boolean")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank from 1 for the drawn ones, else null.

    Of the documents with enough words the given percentage is drawn (rounded down): the highest scores, ties to the smaller id, a
    null id last; it takes part with an empty id in its noise. Rows that repeat an id are drawn one by one. Null, empty and
    wordless texts have no features, weight 0, and are never drawn. Empty tables of documents or targets are
    allowed; texts may be of any length, extra columns are ignored.
    """
    with tidy(docs.sparkSession):
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        runs = written(scored(docs, target, id_col, text_col, **options).sortWithinPartitions(*order), "runs", last=True)
        # scores are thousandths of logarithms of doubles: at most some hundred thousand different ones
        found = runs.where("eligible").groupBy("score").count().toArrow()
    values, n = found.column("score").to_numpy(), found.column("count").to_numpy()
    by = np.argsort(-values)
    values, n = values[by], n[by]
    before = np.cumsum(n) - n
    draw = percent * int(n.sum()) // 100
    drawn = before < draw
    plain = runs.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not drawn.any():
        return plain
    values, before = values[drawn], before[drawn]
    number = before // min(RANGE, max(LEAST_RANGE, -(-draw // RANGES)))
    number = np.unique(number, return_inverse=True)[1]
    first = before[np.searchsorted(number, np.arange(number[-1] + 1))]
    cut = int(values[-1])
    ranges = docs.sparkSession.createDataFrame(pa.table({"value": values, "slice": number.astype(np.int32)}))
    candidates = runs.where(F.col("eligible") & (F.col("score") >= cut)).join(F.broadcast(ranges), F.col("score") == F.col("value"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        every = pa.Table.from_batches(rows)
        at = every.column("slice").to_numpy()
        for s in np.unique(at).tolist():
            t = every.filter(pa.array(at == s)).drop_columns("slice")
            ids = t.column("doc_id")
            order = merged(t.column("score").to_numpy(), np.where(ids.is_null().to_numpy(), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy()), draw - int(first[s]))
            rank = np.zeros(t.num_rows, np.int64)
            rank[order] = first[s] + 1 + np.arange(len(order))
            yield from t.append_column("rank", pa.array(rank, mask=rank == 0)).to_batches()

    dealt = candidates.select("doc_id", "n_features", "weight", "score", "slice").repartitionById(len(first), "slice")
    ranked = dealt.mapInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")
    return ranked.union(plain.where(~(runs["eligible"] & (runs["score"] >= cut))))
