"""Jaccard components against all pairs, groups of copies, frequent passages, and odd rows."""

import random
import re

import numpy as np
import pytest

from tessavox.llm import jaccard
from tessavox.llm.queries import OP12, op12_jaccard


def shingles(text, size=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def slow(docs):
    """Rows of id, size of the set, smallest id of the component, by all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    met = {}
    for same in holders.values():
        for x, a in enumerate(same):
            for b in same[x + 1 :]:
                met[a, b] = met.get((a, b), 0) + 1
    for (a, b), common in met.items():
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def words(rng, n, size=3000):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def changed(rng, base, times):
    out = list(base)
    for _ in range(times):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = f"new{rng.randint(0, 10**6)}"
        elif kind < 0.7:
            out.insert(k, "more")
        elif len(out) > 1:
            del out[k]
    return out


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, docs, parts=7):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)


def test_the_table(spark, duck, data, rows_of, texts):
    got = op12_jaccard(spark, data)
    assert result(got) == slow(texts)
    assert rows_of(got.toArrow()) == rows_of(duck.execute(OP12).to_arrow_table())


@pytest.mark.parametrize("seed", range(2))
def test_groups_near_the_border(spark, seed):
    """Chains of edits, copies whose similarities lie around 0.8, one passage in many texts, short texts."""
    rng = random.Random(seed)
    docs, passage = [], words(rng, 60)
    for _ in range(14):
        base = words(rng, rng.randint(1, 150))
        for _ in range(rng.randint(1, 12)):
            docs.append(changed(rng, base, rng.randint(0, 1 + len(base) // 25)))
            base = docs[-1] if rng.random() < 0.3 else base
    for _ in range(40):
        docs.append(words(rng, rng.randint(5, 120)) + passage + words(rng, rng.randint(0, 60)))
    docs += [words(rng, rng.randint(1, 6), 3) for _ in range(40)]
    docs += rng.choices(docs, k=30)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(rows)
    assert result(jaccard.near_duplicates(frame(spark, rows))) == slow(rows)


@pytest.mark.parametrize("large", [1, 16])
def test_links_that_no_leader_sees(spark, monkeypatch, large):
    """Copies of one text that are too far from each other: their only links go through texts that aren't leaders."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    rng = random.Random(11)
    base = words(rng, 200)
    docs = [changed(rng, base, 5) for _ in range(60)] + [base]
    rows = [(100 + i, " ".join(d)) for i, d in enumerate(docs)]
    got = result(jaccard.near_duplicates(frame(spark, rows)))
    assert got == slow(rows)


@pytest.mark.parametrize("known", [0, 40])
def test_any_order_of_shingles_is_right(spark, monkeypatch, known):
    monkeypatch.setattr(jaccard, "COUNTED", known)
    monkeypatch.setattr(jaccard, "CHUNK", 500)
    monkeypatch.setattr(jaccard, "KNOWN", 5)
    monkeypatch.setattr(jaccard, "PIECE", 64)
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = words(rng, 90)
        rows += [(len(rows) + k, " ".join(changed(rng, base, k % 4))) for k in range(8)]
    assert result(jaccard.near_duplicates(frame(spark, rows))) == slow(rows)


def test_large_groups_make_rows_in_proportion(spark):
    """Candidates of a group of near copies grow with its members, not with their pairs."""
    rng = random.Random(6)
    base = words(rng, 300)
    rows = [(i, " ".join(changed(rng, base, 2))) for i in range(1500)]
    seen = []
    plain = jaccard._compared

    def spied(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    jaccard._compared = spied
    try:
        got = jaccard.near_duplicates(frame(spark, rows)).where("component_id = 0").count()
    finally:
        jaccard._compared = plain
    assert got == 1500
    assert sum(seen) < 20 * 1500


def test_sketches_keep_links_and_spare_the_others(spark):
    """Sketches of any lengths are lower bounds; of pairs that share much, but less than links, most sets aren't sent."""
    rng = np.random.default_rng(3)
    for n, m, common in [(1, 1, 0), (40, 300, 30), (300, 310, 290), (5000, 90, 80), (70000, 60000, 59000)]:
        a = rng.integers(0, 1 << 63, n + m - common).astype(np.uint64)
        one, other = np.sort(a[:n]), np.sort(a[n - common :])
        assert jaccard._differing(jaccard._sketch(one), jaccard._sketch(other)) <= n + m - 2 * common
    dice = random.Random(9)
    passage = words(dice, 200)
    rows = [(i, " ".join(passage + words(dice, 60))) for i in range(60)]
    sent = []
    plain = jaccard._compared

    def spied(pairs, *rest):
        sent.append(pairs.count())
        return plain(pairs, *rest)

    jaccard._compared = spied
    try:
        assert result(jaccard.near_duplicates(frame(spark, rows))) == slow(rows)
    finally:
        jaccard._compared = plain
    assert sum(sent) < 30


def test_shingles_and_bounds(odd_rows):
    s = jaccard.Shingles()
    for _, t in odd_rows:
        assert len(s.of(t or "")) == len(shingles(t))
    for n in range(1, 80):
        for m in range(1, 80):
            i = jaccard.least_overlap(n, m)
            assert 100 * i >= 80 * (n + m - i) and not 100 * (i - 1) >= 80 * (n + m - i + 1)
    assert jaccard.least_overlap(np.array([10]), np.array([10])).tolist() == [9]


def test_odd_rows(spark, odd, odd_rows, none):
    assert result(jaccard.near_duplicates(odd)) == slow(odd_rows)
    assert jaccard.near_duplicates(none).count() == 0


def test_near_misses_are_no_rows_for_each_shared_shingle(spark, monkeypatch):
    """60 texts of one passage of 75 words and 14 own ones: 71 of 99 shingles are shared by two, so nearly all pairs go by the leaders' sketches."""
    seen, written = {}, jaccard.written

    def counted(df, name, **more):
        out = written(df, name, **more)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    passage = " ".join(f"p{k}" for k in range(75))
    rows = [(i, f"{passage} " + " ".join(f"w{i}_{k}" for k in range(14))) for i in range(60)]
    rows += [(60 + i, t.rsplit(" ", 1)[0] + " other") for i, t in rows[:5]]  # near copies, linked with theirs
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 60 for i in range(65)}
    assert seen["both"] < 65 * 64 / 2  # 4 for each pair otherwise


@pytest.mark.parametrize("piece", [16, 300, 1 << 18])
def test_sets_of_a_batch_are_those_of_its_texts(monkeypatch, piece):
    """Texts hashed together: words and shingles end with their text, equal sets get equal hashes and others not, words may be long."""
    monkeypatch.setattr(jaccard, "PIECE", piece)
    dice = random.Random(2)
    some = ["a", "B", "b", " ", "\t", "\n", "é", "word ", "\x00", "  ", "\x1f", "Z\x0b", "x" * 8, "y" * 256, "z" * 300 + " "]
    texts = ["", " ", *("".join(dice.choices(some, k=dice.choice([0, 1, 3, 30]))) for _ in range(300))]
    for size in (1, 2, 5):
        batch = jaccard.pa.array(["left out", *texts]).slice(1)
        got = [tuple(t[a:b].tolist()) for t, at in jaccard.Shingles(size).sets(batch) for a, b in zip(at[:-1], at[1:], strict=True)]
        sets = [shingles(t, size) for t in texts]
        assert [len(s) for s in got] == [len(s) for s in sets]
        assert all(list(s) == sorted(set(s)) for s in got)
        assert len(set(zip(got, sets, strict=True))) == len(set(got)) == len(set(sets))


def test_counts_are_found():
    token = np.unique(np.random.default_rng(5).integers(0, 1 << 64, 999, np.uint64))
    asked = np.sort(np.concatenate([token, token + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)]))
    for n in (0, 1, 2, 999):
        at = dict(zip(token[:n].tolist(), range(1, n + 1), strict=True))
        times = jaccard.Times(token[:n], np.arange(1, n + 1, dtype=np.int32))
        assert times.of(asked).tolist() == [at.get(t, 0) for t in asked.tolist()]
