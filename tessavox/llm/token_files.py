"""Token-ID output: Parquet list columns with dictionary or delta encoding, small pages and page indexes.

Layout of a written folder: one row per document, ascending by id within a file and from file to file:

- ``doc_id`` long
- ``part`` int: number of the file, ascending with the ids
- ``start_in_part`` long: ids of the documents before this one in the same file
- ``n_tokens`` long: with the end id
- ``ids`` array<int>

Pages hold few rows, and the columns are sorted, so a filter on ``doc_id`` reads only the pages that the
page index names; readers that leave out ``ids`` never touch its column chunks.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessavox.llm.common import pick, scratch, whole

#: Entries of each of the two generations of a worker's word cache.
CACHE_WORDS = 400_000
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"

#: Fixed value: the pattern by which byte-level BPE vocabularies of this family cut text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    out = array("i", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Odd(Exception):
    """A piece that the quick cut can't judge alone."""


class _Words(dict):
    """Piece of text -> its ids as little-endian bytes, in two generations of bounded size."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class ByteTokenizer:
    """A byte-level BPE tokenizer of the tokenizers library, with a cache by word.

    Such a tokenizer never merges over a cut of its pattern, and a cut always falls before the single space
    that precedes a word and on both sides of a single line break between words. So the texts are split
    there, and the library encodes each different piece once. Texts in which such a split could differ from the
    library's own cuts (several spaces in a row, space at the ends of lines, special tokens) go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = self.library.pre_tokenizer
        self.plain = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and self.library.normalizer is None
        self.tokens = self.library.model.tokenize
        self.cut = regex.compile(CUT).findall
        self.letters = self._letters()
        self.inner: dict[str, bytes] = {}
        self.words = _Words(self._piece)

    @staticmethod
    def _letters() -> dict[int, str]:
        """The visible letter of each byte: printable bytes stand for themselves, the rest follow from 256 on."""
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(seen)]
        return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _token(self, token: str) -> bytes:
        ids = self.inner.get(token)
        if ids is None:
            if len(self.inner) >= CACHE_WORDS:
                self.inner.clear()
            if token.isascii() and token.lstrip(" ").isprintable():  # such bytes stand for themselves, but the space
                visible = token.replace(" ", self.letters[32])
            else:
                visible = token.encode().decode("latin-1").translate(self.letters)
            ids = self.inner[token] = pack([t.id for t in self.tokens(visible)])
        return ids

    def _piece(self, word: str) -> bytes:
        """word: as split() of encode() gives it; one after a line break is marked by a NUL."""
        if word == "\n":
            return self._token(word)
        bare = word[1:] if word[:1] == "\0" else word
        if not bare or not bare.isprintable():
            raise _Odd
        full = bare if bare is not word else " " + word
        if bare.isascii() or max(bare) < "ɐ":
            if bare.isalpha():
                return self._token(full)
            if bare[-1] in ",.;:!?" and bare[:-1].isalpha():
                return self._token(full[:-1]) + self._token(bare[-1])
        return b"".join(map(self._token, self.cut(full)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.plain and "\0" not in text and not any(s in text for s in self.special):
            try:
                return b"".join(map(self.words.__getitem__, ("\0" + text).replace("\n", " \n \0").split(" ")))
            except _Odd:
                pass
        return pack(self.library.encode(text, add_special_tokens=False).ids)


_loaded: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteTokenizer(path)
    return _loaded[path]


#: Bytes of text of a token file, about.
FILE_BYTES = 1 << 30


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Rows of SCHEMA, in id order from partition to partition: as many as the session shuffles to, more where a file would pass FILE_BYTES of text."""
    spark = docs.sparkSession
    plain = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    if files is None:
        size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = plain.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, start = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        end = pack([end_id])
        for b in _slices(batches):
            each = [t.encode(x) + end for x in b.column(1).to_pylist()]
            n = np.fromiter(map(len, each), np.int64, len(each)) // 4
            offsets = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(each), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(each), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(n), ids], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            start += int(offsets[-1])

    return ordered.mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group_mb: int = 32, page_rows: int = 256, files: int | None = None) -> None:
    """Encode whole texts, append end_id to each, and write them in ascending id order.

    encoding: ``dictionary`` (ids as indexes into a dictionary page) or ``delta`` (DELTA_BINARY_PACKED).
    row_group_mb bounds what a reader holds of a row group; page_rows is the most rows of a page and so the grain of
    selective reads.

    Null texts are empty (just the end id). Rows with a null id come first; rows with equal ids are kept,
    ordered by text. An empty table gives an empty folder of files. Extra columns are not written.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    out = encoded(docs, tokenizer_path, end_id, id_col, text_col, files).write.option("parquet.block.size", row_group_mb << 20).option("parquet.page.row.count.limit", page_rows).option("compression", "zstd")
    if encoding == "delta":
        out = out.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    else:
        out = out.option("parquet.enable.dictionary", "true")
    out.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of a written folder.

    start counts over all files: a sum for each file, added up over the files (one row each), joined back. Filters on
    doc_id and the choice of columns reach the scan.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row of two numbers for each written file
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Write the files into the shared folder and return what read_token_files() reads."""
    path = scratch(docs.sparkSession, "tokens", last=True)
    write_token_files(docs, path, tokenizer_path, end_id, **options)
    return read_token_files(docs.sparkSession, path)


def page_rows_of(path: str) -> list[int]:
    """For inspection: rows of each row group of one local file."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(re.sub("^file:(//)?", "", path)).metadata
    return [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
