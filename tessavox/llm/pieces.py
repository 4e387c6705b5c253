"""SentencePiece encoding and decoding for merge-type (BPE) models, by backtracking.

A sequence of pieces is what the merges give exactly if every two neighbours are compatible: merging the two
pieces' joined text again gives these two pieces. (The first merge over a border would also come first in the
joined text of the two.) So the encoder takes at each position the longest piece that an Aho-Corasick automaton found
there, checks it against the piece before, falls back to the piece's own longest prefix, and, when no prefix fits, takes
the last piece back. A field with a bit for each position keeps the positions from which no encoding goes on; the
pieces up to a position are unique, so a failed position stays failed.

No piece holds a space mark after another character, and none holds a line break; so no merge crosses
a word's start or a line break, and each different word of a worker is encoded once, in a cache of bounded size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import pick, released, whole

MARK = "▁"
#: Entries of each of the two generations of a worker's word cache, and of its cache of pairs.
CACHE_WORDS, CACHE_PAIRS = 300_000, 200_000


def _fields(message: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[i] & 127) << shift
            shift += 7
            i += 1
            if message[i - 1] < 128:
                return value, i

    i = 0
    while i < len(message):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            n, i = number(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = message[i : i + n], i + n
        yield key >> 3, value


def _keeps_text(model: bytes) -> bool:
    """Whether the model's normalisation only puts a space before the text and marks spaces."""
    spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))  # defaults: prefix 1, extra spaces removed 1, marks 1
    return spec.get(2, b"") == b"" and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


class PieceEncoder:
    """Exact ids of a merge-type model without running the library's encoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = f.read()
        trainer = dict(_fields(next((v for k, v in _fields(model) if k == 2), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a model of merge type")
        self.keeps_text = _keeps_text(model)
        ids = range(lib.get_piece_size())
        kinds = {dict(_fields(v)).get(3, 1) for k, v in _fields(model) if k == 1}
        if kinds - {1, 2, 3, 6}:
            raise ValueError("models with pieces that a user defined or that are unused aren't supported")
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.number = {p: f"{lib.piece_to_id(p)}," for p in self.score}
        self.byte = {int(lib.id_to_piece(i)[1:-1], 16): i for i in ids if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.known = {p for p in self.score if len(p) == 1}
        self.by_word = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score)
        self.halves: dict[str, tuple[str, str]] = {}
        reached = [p for p in self.score if self.known.issuperset(p) and self._learn(p)]
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        real = set(reached)
        self.prefix = {p: next((p[:i] for i in range(len(p) - 1, 0, -1) if p[:i] in real), None) for p in reached}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.runs: dict[str, str] = {}
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def merged(self, text: str) -> list[str]:
        """The pieces by merging itself: always the best pair, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _learn(self, piece: str) -> bool:
        """Whether merging gives the piece; then, if its merges come in falling order, keeps the halves of the last."""
        parts, score, last, falls, halves = list(piece), self.score, float("inf"), True, None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            falls &= best <= last
            last, halves = best, (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1 and falls:
            self.halves[piece] = halves or (piece, "")
        return len(parts) == 1

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b again.

        Where both pieces' own merges come in falling order of score, it takes them back one by one, the latest first,
        and looks for a merge over the border that would have come before the one just taken back. Else it merges anew.
        """
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        halves, score = self.halves, self.score
        if a not in halves or b not in halves:
            fits = self.merged(a + b) == [a, b]
        else:
            fits, left, right, limit, of_right = True, a, b, float("-inf"), False
            while True:
                s = score.get(left + right)
                if s is not None and (s > limit or s == limit and of_right):
                    fits = False
                    break
                last_l = score[left] if halves[left][1] else float("inf")
                last_r = score[right] if halves[right][1] else float("inf")
                if last_l == last_r == float("inf"):
                    break
                # of equal merges the left one comes first, so the right one is taken back first
                of_right = last_r <= last_l
                if of_right:
                    limit, right = last_r, halves[right][0]
                else:
                    limit, left = last_l, halves[left][1]
                if left not in halves or right not in halves:
                    fits = self.merged(a + b) == [a, b]
                    break
        self.pairs[a, b] = fits
        return fits

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all known, by backtracking."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # longer ones end later
        failed: bytearray | None = None  # a bit for each position, once one has failed
        taken: list[str] = []
        at, piece, last, prefix, pairs = 0, longest[0], None, self.prefix, self.pairs
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if last is None:
                        break
                    fits = pairs.get((last, piece))
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = prefix[piece]
            if piece is None:
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                taken.pop()
                at -= len(last)
                piece = prefix[last]
                last = taken[-1] if taken else None
            else:
                taken.append(piece)
                at, last = end, piece
                piece = longest[at] if at < n else None
        return taken

    def text_of(self, text: str) -> str:
        """The decimal ids of a normalised text, each with a comma after it.

        Unknown characters become their bytes, and nothing merges with them.
        """
        number = self.number.__getitem__
        if self.known.issuperset(text):
            return "".join(map(number, self.pieces(text))) if text else ""
        out, run = [], 0
        for i, c in enumerate(text):
            if c not in self.known:
                if run < i:
                    out += map(number, self.pieces(text[run:i]))
                out += [f"{self.byte[b]}," for b in c.encode()] if self.byte else [f"{self.unknown},"]
                run = i + 1
        if run < len(text):
            out += map(number, self.pieces(text[run:]))
        return "".join(out)

    def _text_of(self, segment: str) -> str:
        """The decimal ids of a segment, each with a comma after it."""
        out = self.runs.get(segment)
        if out is None:
            out = self.text_of(segment)
            if len(self.runs) >= CACHE_WORDS:
                self.runs.clear()
            self.runs[segment] = out
        return out

    def encode_text(self, text: str) -> str:
        """The decimal ids of a whole text, joined by commas."""
        if not text:
            return ""
        if not self.keeps_text:
            text = self.library.normalize(text)
        elif self.by_word and "\0" not in text:
            # after a line break a NUL stands for the missing space mark
            words = text.replace(MARK, " ").replace("\n", " \n \0").split(" ")
            if "" not in words:
                get, make = self.cache.get, self._word
                return "".join([get(w) or make(w) for w in words])[:-1]
            text = MARK + text.replace(" ", MARK)
        else:
            text = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.text_of(text)[:-1]
        return "".join([self._text_of(line) for s in self.segments(text) for line in re.split("(\n)", s) if line])[:-1]

    def _word(self, word: str) -> str:
        if word in ("\n", "\0"):
            return self._text_of(word) if word == "\n" else ""
        out = self.old.get(word)
        if out is None:
            out = self.text_of(word[1:] if word[0] == "\0" else MARK + word)
        if len(self.cache) >= CACHE_WORDS:
            self.old, self.cache = dict(self.cache), self.cache
            self.cache.clear()
        self.cache[word] = out
        return out


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encode and decode whole texts: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids unless left out.

    Null and empty texts have no ids and decode to an empty text. Every row, also with a null or
    repeated id, gives one row. Extra columns are ignored. No row moves: there is no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        decode = e.library.decode
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                n, coded, decoded, lists, flat = [], [], [], [0], array("i")
                for text in b.column(1).to_pylist():
                    s = e.encode_text(text)
                    numbers = list(map(int, s.split(","))) if s else []
                    n.append(len(numbers))
                    coded.append(sha256(s.encode()).hexdigest())
                    decoded.append(sha256((decode(numbers) if numbers else "").encode()).hexdigest())
                    if ids:
                        flat.extend(numbers)
                        lists.append(len(flat))
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    plain = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return plain.mapInArrow(lambda batches: released(run(batches)), schema)
