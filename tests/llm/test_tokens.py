"""Token files and piece encoding against the libraries, on odd texts and the small table."""

import glob
import random
import zlib
from hashlib import sha256

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessavox.llm import pieces, token_files
from tessavox.llm.common import table
from tessavox.llm.queries import op2_token_files, op3_piece_codec, vocabulary

ODD = ["", " ", "  ", "\n", "\n\n", "a  b", " a", "a ", "a\n b", "a \nb", "a\n\n\nb  c\n", "it's they're 've", "x\0y \0", "<|endoftext|> a  <|endoftext|>b", "日本語 ▁▁ x▁y ▁", "é́ ﬁ b c", "a\tb\t c", "😀 👍🏽 x", "123 45.6 7a8b", "----- ....  \n  indented\n\tcode {x}", "<s> </s> <0x41>", "a\r\nb\r\n", "​zero­soft", "ab" * 3000, " " * 500 + "x", "a" * 40, "\x1c a \x85b c\x1f"]


def garbled(n):
    rng = random.Random(3)
    return ["".join(rng.choices("abcdethe ion  \n\n.,'s1é日▁\t\0<", k=rng.randint(1, 60))) for _ in range(n)]


def test_words_encode_like_the_whole(texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.ByteTokenizer(path)
    for t in ODD + garbled(1500) + [t for _, t in texts]:
        assert np.frombuffer(own.encode(t), "<i4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def piece_encoder():
    return pieces.PieceEncoder(vocabulary("piece_bpe_32k.model"))


def test_pieces_like_the_library(piece_encoder, texts):
    for t in ODD + garbled(1500) + [t for _, t in texts]:
        assert piece_encoder.encode_text(t) == ",".join(map(str, piece_encoder.library.encode(t)))


def test_compatibility_like_merging(piece_encoder):
    rng = random.Random(5)
    some = [p for p in piece_encoder.prefix if set(p) <= set("aeo▁nst")]
    for _ in range(20_000):
        a, b = rng.choice(some), rng.choice(some)
        assert piece_encoder.compatible(a, b) == (piece_encoder.merged(a + b) == [a, b])


def test_backtracking_is_needed_and_right(piece_encoder):
    rng = random.Random(6)
    tried = 0
    for _ in range(3000):
        t = "".join(rng.choices("▁aeinorstlhdc", k=rng.randint(2, 25)))
        got = piece_encoder.pieces(t)
        assert got == piece_encoder.merged(t)
        at, greedy = 0, []
        while at < len(t):
            greedy.append(next(t[at:e] for e in range(len(t), at, -1) if t[at:e] in piece_encoder.prefix))
            at += len(greedy[-1])
        tried += greedy != got
    assert tried > 50


def expected(rows, path, end):
    from tokenizers import Tokenizer

    library, start, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, odd_rows, tmp_path, encoding):
    path, to = vocabulary("byte_bpe_50k.json"), str(tmp_path / "t")
    token_files.write_token_files(odd, to, path, 2, encoding=encoding, files=3, page_rows=4)
    read = token_files.read_token_files(spark, to)
    got = [tuple(r) for r in token_files.with_crc32(read).orderBy("start").collect()]
    assert got == expected(odd_rows, path, 2)
    meta = [pq.ParquetFile(f).metadata.row_group(0) for f in glob.glob(f"{to}/*.parquet")]
    ids = [g.column(g.num_columns - 1) for g in meta]
    assert all(c.has_column_index and c.has_offset_index for c in ids)
    assert all(any("DELTA" in e for e in c.encodings) if encoding == "delta" else c.has_dictionary_page for c in ids)
    plan = read.where("doc_id = 5").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_token_files_of_nothing(spark, none, tmp_path):
    token_files.write_token_files(none, str(tmp_path / "t"), vocabulary("byte_bpe_50k.json"), 2)
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0
    with pytest.raises(ValueError):
        token_files.write_token_files(none, "x", "y", 2, encoding="rle")


def test_op2_on_the_table(spark, data, texts):
    got = sorted(tuple(r) for r in op2_token_files(spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(texts, vocabulary("byte_bpe_50k.json"), 2)


def digests(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "")
        out.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode() if ids else b"").hexdigest()))
    return sorted(out, key=str)


def test_encode_decode(spark, odd, odd_rows, none, data, texts, piece_encoder):
    path = vocabulary("piece_bpe_32k.model")
    out = pieces.encode_decode(odd, path)
    assert sorted((tuple(r)[:4] for r in out.collect()), key=str) == digests(piece_encoder.library, odd_rows)
    assert all(len(r.ids) == r.n_tokens for r in out.collect())
    assert pieces.encode_decode(none, path).count() == 0
    got = op3_piece_codec(spark, data).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == digests(piece_encoder.library, texts)
    assert table(spark, data, "documents").count() == len(got)
