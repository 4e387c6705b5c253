"""Benchmark decontamination: an FM-index for each shard of documents, searched backward for the test phrases.

A shard is a run of whole documents of one task, about SHARD_WORDS words; its index covers all of them, in numbers of the
shard's own words, whatever is searched later. All phrases are searched at once through the ranks of a wavelet
matrix, occurrences are located by sampled suffix positions, and the covered words of each document are
merged into spans. Documents never move between tasks, and a benchmark of many blocks is searched block by block in the same pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import pick, released, whole
from tessavox.llm.fm_index import FIRST, SEPARATOR, FMIndex

WINDOW = 13
#: Words of a shard, and most benchmark words that a task holds at once.
SHARD_WORDS, BLOCK_WORDS = 1 << 20, 2_000_000
#: Fixed value: the words of lower-cased text.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

STATE = "n_words_ long, spans_ array<struct<start:int,end:int>>, items_ array<string>"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then WORD, in UTF-8: every byte of a character beyond ASCII belongs to a word."""
    return text.encode().translate(_KEEP).split() if text else []


def spans_in_text(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of characters."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


class Phrases:
    """Windows of a block of benchmark items, as numbers of the block's words; each window keeps the items that hold it."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [number.setdefault(x, len(number)) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                held.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.words = list(number)
        self.by_length: dict[int, tuple[np.ndarray, list[set[str]]]] = {}
        for n in sorted({len(p) for p in held}):
            some = [p for p in held if len(p) == n]
            self.by_length[n] = np.array(some, np.int64), [held[p] for p in some]


class Shard:
    """All words of some documents under an FM-index; hits gather over the blocks of phrases that are searched."""

    def __init__(self, texts: list[str | None]):
        self.texts = len(texts)
        seq = self._coded(texts)  # nothing else that it is made from stays while the index is built
        self.index = FMIndex(seq) if self.sizes.any() else None
        self.cover = np.zeros(len(seq) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in texts]

    def _coded(self, texts: list[str | None]) -> np.ndarray:
        """Numbers of all words, with separators; known, sizes and begins are set."""
        spaced = pa.array([t.encode().translate(_KEEP) if t else b"" for t in texts], pa.large_binary()).cast(pa.large_string())
        parts = pc.ascii_split_whitespace(spaced)
        words, text_of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
        real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty part
        words, text_of = words.filter(real), text_of[real.to_numpy(zero_copy_only=False)]
        coded = words.dictionary_encode()
        self.known = coded.dictionary
        self.sizes = np.bincount(text_of, minlength=self.texts)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # a separator ends each document
        seq = np.full(int(self.begins[-1]), SEPARATOR, np.int32)
        seq[np.arange(len(text_of)) + text_of] = coded.indices.to_numpy() + FIRST
        return seq

    def search(self, p: Phrases) -> None:
        """Marks the words of all occurrences of the phrases, and the items found, document by document."""
        if self.index is None or not p.by_length:
            return
        number = pc.index_in(pa.array(p.words, pa.large_binary()).cast(pa.large_string()), self.known)
        number = number.fill_null(-FIRST - 1).to_numpy().astype(np.int64) + FIRST
        for n, (windows, held) in p.by_length.items():
            patterns = number[windows]
            here = np.flatnonzero((patterns >= FIRST).all(axis=1))
            a, b = self.index.search(patterns[here])
            count = b - a
            if not count.sum():
                continue
            which = np.repeat(here, count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            at = self.index.locate(rows)
            np.add.at(self.cover, at, 1)
            np.add.at(self.cover, at + n, -1)
            doc = np.searchsorted(self.begins, at, "right") - 1
            for pair in np.unique(doc * len(held) + which).tolist():
                self.items[pair // len(held)] |= held[pair % len(held)]

    def spans(self) -> list[list[tuple[int, int]]]:
        """Merged spans of hit words of each document."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.texts)]
        hit = np.concatenate([[0], (np.cumsum(self.cover[:-1]) > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(hit))
        doc = np.searchsorted(self.begins, edge[::2], "right") - 1
        for d, a, b in zip(doc.tolist(), (edge[::2] - self.begins[doc]).tolist(), (edge[1::2] - self.begins[doc]).tolist(), strict=True):
            out[d].append((a, b))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items that have an id and a text, a block at a time: the driver holds one block."""
    items = pick(benchmark, item=item_col, text=text_col).where("item is not null and text is not null").select(F.col("item").cast("string").alias("item"), "text")
    block, n = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        block.append((r.item, r.text))
        n += len(words_of(r.text))
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def found(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents' columns as c0_, c1_, ... and n_words_, spans_ (of words, merged) and items_ (sorted as strings).

    The benchmark goes to the tasks in blocks, one after the other through the driver; a task holds one at a time.
    """
    now = docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))])
    text_at = docs.columns.index(text_col)
    context = docs.sparkSession.sparkContext
    # each of at most block_words words and one item more
    sent = [context.broadcast(Phrases(block, window)) for block in _blocks(benchmark, item_col, item_text_col, block_words)]
    names = [f.split(" ")[0] for f in STATE.split(", ")]

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard([t for b in held for t in b.column(text_at).to_pylist()])
        for block in sent:
            shard.search(block.value)
            if len(sent) > 1:
                block.__dict__.pop("_value", None)  # it is loaded again from the executor's copy when needed
        spans, i = shard.spans(), 0
        for b in held:
            s, t, n = spans[i : i + b.num_rows], shard.items[i : i + b.num_rows], shard.sizes[i : i + b.num_rows]
            i += b.num_rows
            flat = [y for x in s for y in x]
            where = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)], ["start", "end"])
            state = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in s])]), pa.int32()), where), pa.array([sorted(x) for x in t], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *state], [*b.schema.names, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                held.append(batch.slice(i, 64))
                # a word and the space behind it, about
                size += pc.sum(pc.binary_length(held[-1].column(text_at))).as_py() or 0
                if size >= 6 * shard_words:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema] + [STATE])
    return now.mapInArrow(lambda batches: released(run(batches)), schema)


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words) of every row.

    Null and empty texts, and texts without words, have no hits; so has everything if the benchmark has no words.
    Items without id or text are left out, items with equal ids count once. Repeated rows get equal
    results. Extra columns are ignored.
    """
    plain = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return found(plain, benchmark, "text", **options).select(
        F.col("c0_").alias("doc_id"),
        F.col("n_words_").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.size("items_").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items_"), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
        F.col("spans_").alias("spans"),
    )


def _n_hit():
    return F.aggregate("spans_", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _contaminated():
    return (_n_hit() > 0) & (20 * _n_hit() >= F.col("n_words_"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", cut: bool = False, **options) -> DataFrame:
    """The documents without contaminated ones; with cut=True these stay and lose the hit words instead.

    Other documents stay as they are.
    """
    back = [F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)]
    rows = found(docs, benchmark, text_col, **options)
    if not cut:
        return rows.where(~_contaminated()).select(*back)
    at = docs.columns.index(text_col)

    @F.arrow_udf("string")
    def without(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if not s:
                out.append(t)
                continue
            kept, last = [], 0
            for a, b in spans_in_text(t, [(x["start"], x["end"]) for x in s]):
                kept.append(t[last:a])
                last = b
            out.append("".join([*kept, t[last:]]))
        return pa.array(out, pa.string())

    new = F.when(_contaminated(), without(f"c{at}_", "spans_")).otherwise(F.col(f"c{at}_"))
    return rows.withColumn("new_", new).select(*[F.col("new_").alias(c) if i == at else back[i] for i, c in enumerate(docs.columns)])


def digest_of(items: list[str]) -> str:
    """What items_sha256 holds, for tests."""
    return sha256(",".join(sorted(items)).encode()).hexdigest()
