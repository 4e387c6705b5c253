"""Importance resampling against a plain computation, ties and repeated rows, and the merge of runs."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tessavox.llm import importance
from tessavox.llm.queries import OP13, op13_resampling


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def slow(docs, targets, percent=25):
    """docs: id and text; every row's id, n_features, weight, score, rank."""
    made = [(i, *features(t)) for i, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, _, f in made:
        for b in f:
            s[b] += 1
    for x in targets:
        for b in features(x)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    best = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(best[: percent * len(best) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_the_table(spark, duck, data, rows_of, texts):
    got = op13_resampling(spark, data)
    items = [t for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    assert sorted(map(tuple, got.collect()), key=str) == slow(texts, items)
    assert rows_of(got.toArrow()) == rows_of(duck.execute(OP13).to_arrow_table())


def test_hashes_of_all_kinds_of_words(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 40)
    monkeypatch.setattr(importance, "TOGETHER", 25)
    monkeypatch.setattr(importance, "KNOWN", 30)
    rng = random.Random(2)
    texts = ["", "one", "a b", "x" * 200 + " y", "y " + "x" * 200, "Ünï CODE 7z_b 漢字 " * 9, *[" ".join("ab1é"[rng.randint(0, 3)] * rng.choice([1, 2, 61, 62, 63, 64, 65, 300]) for _ in range(rng.randint(0, 90))) for _ in range(30)]]
    words, found = {}, {}
    for w, t, b in importance.Features().of(iter(texts)):
        for k in w.tolist():
            words[k] = words.get(k, 0) + 1
        for k, x in zip(t.tolist(), b.tolist(), strict=True):
            found.setdefault(k, []).append(x)
    for k, text in enumerate(texts):
        n, f = features(text)
        assert words.get(k, 0) == n and sorted(found.get(k, [])) == sorted(f)


@pytest.mark.parametrize("seed", range(30))
def test_merge_of_runs(seed):
    rng = np.random.default_rng(seed)
    score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(rng.integers(1, 9)):
        s, i = rng.integers(0, 6, 20), rng.integers(0, 50, 20)
        by = np.lexsort((i, -s))
        score, ids = np.concatenate([score, s[by]]), np.concatenate([ids, i[by]])
    take = int(rng.integers(0, len(score) + 3))
    got = importance.merged(score, ids, take)
    assert len(set(got.tolist())) == len(got) == min(take, len(score))
    want = sorted(zip((-score).tolist(), ids.tolist(), strict=True))[:take]
    assert [(-int(score[k]), int(ids[k])) for k in got] == want


def test_many_ranges_and_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "LEAST_RANGE", 8)
    rng = random.Random(5)
    docs = [(rng.randint(0, 120), " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "7"], k=rng.randint(15, 60)))) for _ in range(700)]
    docs += [(7, docs[0][1])] * 40
    target = ["alpha beta alpha beta gamma"] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(map(tuple, got.collect()), key=str)
    want = slow(docs, target)
    # rows with the same id and score may change places
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted((r[4], r[0], r[3]) for r in got if r[4]) == sorted((r[4], r[0], r[3]) for r in want if r[4])


def test_odd_rows(spark, odd, odd_rows, none):
    target = spark.createDataFrame([("same line of several words",), (None,)], "text string")
    got = sorted(map(tuple, importance.resampled(odd, target, percent=60).collect()), key=str)
    want = slow(odd_rows, ["same line of several words", None], 60)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    assert importance.resampled(none, target).count() == 0
    no_target = importance.resampled(odd, target.limit(0))
    assert sorted(tuple(r)[:4] for r in no_target.where("doc_id is not null").collect()) == sorted(r[:4] for r in slow(odd_rows, []) if r[0] is not None)
