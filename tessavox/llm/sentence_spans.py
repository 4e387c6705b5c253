"""Substring dedup by sliding sentence spans: every run of several sentences is hashed and held against the whole corpus.

Every run of WINDOW consecutive sentences is hashed, whatever their length. Passages of fewer but longer sentences go too: of the
runs that begin at a sentence, and of those that end there, the shortest of MIN_WORDS words is hashed as well, several
sentences, or one that has as many words alone (``min_words=0`` leaves these out). Either kind covers every sentence of any longer
repeated run: what the shortest run at its begin leaves has enough words before it for a run that ends there. Sentences of over LONG_WORDS words, as in texts without
stops, are cut into pieces at places that depend on the words around, and the pieces count as sentences. All sentences that
a repeated run covers go, except where the run stands for the first time (smallest id, then place). Two passes read the
texts: the first gathers one hash for each run with its first and last place (partial sums before the shuffle), the
second finds the repeated ones again with a second hash, so that collisions of the first don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import pick, tidy, whole, written

WINDOW, MIN_SENTENCES, MIN_WORDS = 3, 2, 20
#: Words from which on a sentence is cut; words on each side that decide whether it is cut behind one.
LONG_WORDS, REACH = 50, 4
#: Fixed value: where a sentence ends, closing marks and white space included. One set of first characters is found fast.
END = re.compile(r"[.!?…。！？\n](?:(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])[”’」』]*\s*|(?<=\n)\s*)")
_WORD = re.compile(r"\S+\s*")
_PLACES, _LAST_ID = 10**10, (1 << 63) - 1


def _pieces(sentence: str) -> list[str]:
    """A long sentence, cut behind words whose hash (with the word before) is the least of REACH on each side.

    Equal stretches so are cut alike whatever stands around them, but for their ends. What has no such place (one
    word again and again) is cut by length.
    """
    words = sentence.split()
    if len(words) <= LONG_WORDS:
        return [sentence]
    first = len(sentence) - len(sentence.lstrip())
    ends = [m.end() for m in _WORD.finditer(sentence, first)]
    words = [w.lower() for w in words]
    h = [xxhash.xxh32_intdigest(f"{a} {b}".encode()) for a, b in zip(["", *words], words, strict=False)]
    at = [0]
    for i in range(REACH, len(h) - REACH):
        if h[i] < min(h[i - REACH : i]) and h[i] <= min(h[i + 1 : i + REACH + 1]):
            at += [*range(at[-1] + LONG_WORDS // 2, i + 1 - LONG_WORDS // 2, LONG_WORDS // 2)] if i + 1 - at[-1] > LONG_WORDS else []
            at.append(i + 1)
    at += [*range(at[-1] + LONG_WORDS // 2, len(h) - LONG_WORDS // 2, LONG_WORDS // 2)] if len(h) - at[-1] > LONG_WORDS else []
    cuts = [0, *(ends[i - 1] for i in at[1:]), len(sentence)]
    return [sentence[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sentences(text: str) -> list[str]:
    """Pieces whose concatenation is the text."""
    cuts = [0, *(m.end() for m in END.finditer(text))]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 2 * LONG_WORDS:
            out += _pieces(text[a:b])
        else:
            out.append(text[a:b])
    return out


def _lowered(text: str) -> Iterator[list[str]]:
    """The lower-cased words of each of the text's ``sentences``."""
    cuts = [0, *(m.end() for m in END.finditer(text))]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        words = text[a:b].lower().split()
        if len(words) <= LONG_WORDS:
            yield words
        else:
            yield from (p.lower().split() for p in _pieces(text[a:b]))


def _found(text: str, window: int = WINDOW, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Begins, ends and 16-byte hashes of the runs, by begin and end."""
    parts = [*_lowered(text)]
    sizes = np.array([*map(len, parts)], np.int64)
    real = np.flatnonzero(sizes)
    n, sizes = len(real), sizes[real]
    step = n + 1
    begin = np.arange(n)
    spans = [begin[: max(0, n - window + 1)] * (step + 1) + window]
    if min_words:
        words = np.concatenate([[0], np.cumsum(sizes)])
        least = min_sentences if min_sentences > 2 else 1  # of two, one either has the words alone or needs the other
        spans.append(begin[sizes >= min_words] * (step + 1) + 1)
        end = np.maximum(np.searchsorted(words, words[:-1] + min_words), begin + least)  # the shortest that begin here
        spans.append((begin * step + end)[end <= n])
        end = begin + 1
        first = np.minimum(np.searchsorted(words, words[1:] - min_words, side="right") - 1, end - least)  # the shortest that end here
        spans.append((first * step + end)[first >= 0])
    begin, end = np.divmod(np.unique(np.concatenate(spans)), step)
    joined = [" ".join(w).encode() for w in parts if w]
    whole_ = b" ".join(joined)
    at = np.concatenate([[0], np.cumsum(np.array([*map(len, joined)], np.int64) + 1)])
    digest = xxhash.xxh3_128_digest
    hashes = [digest(whole_[a:b]) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist(), strict=True)]
    return real[begin], real[end - 1] + 1, hashes


def runs(text: str, window: int = WINDOW, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """begin, end and 16-byte hash of each run; sentences compare as lower-cased words. Wordless pieces don't count."""
    begin, end, hashes = _found(text, window, min_sentences, min_words)
    yield from zip(begin.tolist(), end.tolist(), hashes, strict=True)


_RUN = {"doc_id": "long", "row_key": "long", "begin": "int", "end": "int", "h1": "long", "h2": "long"}


def _all_runs(docs: DataFrame, options: dict, columns: Iterable[str] = _RUN) -> DataFrame:
    """One row for each run of the rows of doc_id and text; row_key tells rows with equal ids apart."""
    names = [*columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                texts = b.column(1).to_pylist()
                begin, end, hashes = zip(*[_found(t, **options) for t in texts], strict=True)
                count = [*map(len, hashes)]
                both = np.frombuffer(b"".join(b"".join(h) for h in hashes), "<i8").reshape(-1, 2)
                of = {"begin": lambda: np.concatenate(begin).astype(np.int32), "end": lambda: np.concatenate(end).astype(np.int32), "h1": lambda: both[:, 0].copy(), "h2": lambda: both[:, 1].copy()}  # noqa: B023
                of["row_key"] = lambda: np.repeat(np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in texts], np.uint64).view(np.int64), count)  # noqa: B023
                of["doc_id"] = lambda: b.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)))  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(of[c]()) if c != "doc_id" else of[c]() for c in names], names)

    return docs.mapInArrow(run, ", ".join(f"{c} {_RUN[c]}" for c in names))


def _place() -> Column:
    """Order of places; rows without an id come last."""
    return (F.coalesce("doc_id", F.lit(_LAST_ID)).cast("decimal(38,0)") * F.lit(_PLACES).cast("decimal(11,0)") + F.col("begin")).cast("decimal(38,0)")


def repeated_spans(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, row_key, spans (array of begin and end sentences) of the rows that repeat runs of earlier places."""
    # two places differ in their id or in their begin; four longs cost less than the order of places does
    places = _all_runs(docs, options, ["doc_id", "begin", "h1"]).select("h1", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), "begin")
    ends = [f("id") for f in (F.min, F.max)] + [f("begin") for f in (F.min, F.max)]
    twice = places.groupBy("h1").agg(*[e.alias(c) for e, c in zip(ends, "abcd", strict=True)]).where("a != b OR c != d").select("h1")
    # both joins shuffle at every size: their smaller sides grow with the corpus, too
    found = written(_all_runs(docs, options).join(written(twice, "twice"), "h1", "left_semi"), "runs")
    first = found.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first != last").select("h1", "h2", "first")
    later = found.join(written(first, "first"), ["h1", "h2"]).where(_place() > F.col("first"))
    return later.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without the removed sentences, n_sentences, n_removed, removed (sentence numbers, from 0) of every row.

    Null and empty texts have no sentences; texts of too few sentences and words have no runs and stay.
    Rows with equal id and text are one document and get equal results. Rows without an id count as one
    document behind all others. Extra columns are ignored. A place within a document counts like one
    in another: the second of two equal runs of one text goes too.
    """
    plain = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    with tidy(docs.sparkSession):
        spans = written(repeated_spans(plain, window=window, min_sentences=min_sentences, min_words=min_words), "spans", last=True).withColumnRenamed("doc_id", "r_id")
    # no broadcast is asked for here either: a share of all documents has spans
    joined = plain.join(spans, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.xxhash64("text") == F.col("row_key")), "left")

    @F.arrow_udf("struct<text:string,n_sentences:long,removed:array<int>>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            parts = sentences(t)
            gone = {i for s in found or () for i in range(s["begin"], s["end"])}
            out.append({"text": "".join([p for i, p in enumerate(parts) if i not in gone]) if gone else t, "n_sentences": len(parts), "removed": sorted(gone)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("removed", pa.list_(pa.int32()))]))

    done = joined.select("doc_id", cut("text", "spans").alias("r"))
    return done.select("doc_id", "r.text", "r.n_sentences", F.size("r.removed").cast("long").alias("n_removed"), "r.removed")
