"""Decontamination, sanitisation, line dedup, quality rules and sentence spans against brute force and on odd rows."""

import itertools
import math
import random
import re
import time
import tracemalloc
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tessavox.llm import common, decontaminate, fm_index, line_dedup, quality_rules, sanitise, sentence_spans
from tessavox.llm.queries import OP6, op1_decontamination, op4_sanitisation, op6_line_dedup, op7_quality_rules, op9_sentence_spans


def sha(s):
    return sha256(s.encode()).hexdigest()


# --- decontamination


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    for _ in range(60):
        seq = rng.integers(2, 2 + rng.integers(1, 5), rng.integers(1, 120))
        seq[rng.random(len(seq)) < 0.1] = fm_index.SEPARATOR
        index = fm_index.FMIndex(seq, int(rng.integers(1, 9)))
        for n in (1, 2, 3, 5):
            patterns = rng.integers(2, 7, (20, n))
            for p, lo, hi in zip(patterns, *index.search(patterns), strict=True):
                places = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(lo, hi)).tolist()) == places


@pytest.mark.parametrize("letters", [1, 2, 3, 40, 5000])
def test_suffixes_are_in_order(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 7, 300):
        seq = rng.integers(2, 2 + letters, n)
        seq[rng.random(n) < 0.05] = fm_index.SEPARATOR
        seq = np.concatenate([seq, np.tile(seq[:50], 2), [fm_index.END]])
        at = {int(i): k for k, i in enumerate(np.flatnonzero(seq == fm_index.SEPARATOR))}
        # separators rise from the left and stand between the end and all words
        plain = [(1, at[i]) if i in at else (2, int(x)) if x else (0, 0) for i, x in enumerate(seq.tolist())]
        assert fm_index.suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: plain[i:])


def test_a_worker_holds_little_beside_its_batch():
    """An index of a shard is built in 50 bytes a word at most (81 once), and a batch's texts are never all copied at once."""

    def peak(work):
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    seq = np.random.default_rng(5).zipf(1.3, 1 << 17) % 50_000 + fm_index.FIRST
    seq[::400] = fm_index.SEPARATOR
    assert peak(lambda: fm_index.FMIndex(seq)) < 50 * len(seq)
    batch = pa.array(["x" * 1000, None] * 5000)
    assert peak(lambda: [None for _ in common.texts(batch)]) < 1 << 20
    assert list(common.texts(batch)) == batch.to_pylist()
    held = [pa.record_batch({"n": [1, 2]}), pa.record_batch({"n": pa.array([], pa.int64())})]
    assert list(common.released(iter(held))) == held


def test_phrases_unknown_when_the_index_was_built(texts):
    """One index of a shard answers for any phrases, one block after the other; also for words that no benchmark holds."""
    shard = decontaminate.Shard([t for _, t in texts])
    assert shard.index.n == sum(len(decontaminate.words_of(t)) + 1 for _, t in texts) + 1
    rng = random.Random(1)
    for window in (1, 3, 13):
        for _ in range(20):
            i = rng.randrange(len(texts))
            w = decontaminate.words_of(texts[i][1])
            if len(w) >= window:
                k = rng.randrange(len(w) - window + 1)
                shard.cover[:] = 0
                shard.search(decontaminate.Phrases([("x", b" ".join(w[k : k + window]).decode()), ("y", "notaword anywhere")], window))
                assert any(a <= k and b >= k + window for a, b in shard.spans()[i]) and "x" in shard.items[i] and "y" not in shard.items[i]


def contaminated(rows, items, window=13):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    held = {}
    for i, t in items:
        w = split(t)
        if i is not None:
            for k in range(max(1, len(w) - window + 1) if w else 0):
                held.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes, out = sorted({len(p) for p in held}), []
    for i, t in rows:
        w = split(t)
        hit, found = set(), set()
        for n, k in itertools.product(sizes, range(len(w))):
            if h := held.get(tuple(w[k : k + n])):
                if len(w[k : k + n]) == n:
                    hit |= set(range(k, k + n))
                    found |= h
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination_on_the_table(spark, data, texts, duck):
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    got = sorted((tuple(r) for r in op1_decontamination(spark, data).select(COLUMNS).collect()), key=str)
    assert got == contaminated(texts, items)
    assert any(r[-1] for r in got)
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    blocks = decontaminate.decontamination(docs, bench, block_words=700, shard_words=5000)  # about ten blocks, searched in many shards
    assert sorted((tuple(r) for r in blocks.select(COLUMNS).collect()), key=str) == got


@pytest.mark.parametrize("options", [{}, {"shard_words": 1}, {"block_words": 1}])
def test_decontamination_of_odd_rows(spark, odd, odd_rows, none, options):
    plain = odd_rows[4][1]
    items = [(1, plain[:200]), (2, "One"), (3, None), (None, plain), (4, ""), (5, "two words"), (5, plain[100:300]), (10, plain[:200]), (6, "X" * 50_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontamination(odd, bench, **options).select(COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == contaminated(odd_rows, items)
    assert decontaminate.decontamination(none, bench).count() == 0
    assert decontaminate.decontamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_contaminated_rows_go_or_lose_words(spark, odd, odd_rows):
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    left = decontaminate.decontaminated(odd, bench)
    assert left.columns == odd.columns
    assert left.count() == len(odd_rows) - 1
    text = decontaminate.decontaminated(odd, bench, cut=True)
    at = text.columns.index("text")
    assert "" in [r[at] for r in text.collect() if r[text.columns.index("doc_id")] == 11]


# --- sanitisation


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_of(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_entities(spark, texts):
    rng = random.Random(2)
    odd = ["", "a@b.c_d@e.com 1.2.3.4.5 999.1.1.1 +1 (555) 123-4567 4111 1111 1111 1111 é😀 x@y.zz 00255.1.1.1", "a" * 3000 + "@" + "b." * 3000, "1 " * 4000, "1" * 20_000, "+1" + "(" * 5000, "1." * 4000 + "1", "x@y.z" * 800]
    odd += ["".join(rng.choices("a1.@+- ()5é", k=rng.randint(1, 60))) for _ in range(800)]
    odd += ["".join(rng.choices("0123456789 -", k=rng.randint(14, 40))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i long, t string").select("i", sanitise.listed(sanitise.base_spans(F.col("t"))).alias("s")).collect()
    for r in rows:
        assert r.s == base_of(odd[r.i]), odd[r.i][:80]


def test_sanitisation_on_the_table(spark, data, texts):
    got = {r.doc_id: r for r in op4_sanitisation(spark, data).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        listed = base_of(t)
        kinds = Counter(x.split(":")[0] for x in listed.split(",") if x)
        r = got[i]
        assert r.base_sha256 == sha(listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in sanitise.KINDS[:4]]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def told_by_hand(rows, share=sanitise.SHARE):
    """Text and spans of the disclosing terms of each text with entities, from counts over all pairs of a document and a key."""
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}"]
    term = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}])?")
    n, n_t, n_e, n_et, texts, held, every = len(rows), Counter(), Counter(), Counter(), {}, {}, {}
    for _, t in rows:
        t = t or ""
        n_t.update(set(term.findall(t.lower())))
        found = sorted((m.start(), k, m.end(), m[0].lower()) for k, p in enumerate(patterns) for m in re.finditer(p, t))
        blank = list(t)
        for a, _, b, _ in found:
            blank[a:b] = " " * (b - a)
        blank = "".join(blank)
        places = [(m.start(), m.end(), m[0].lower()) for m in term.finditer(blank)]
        pairs = set()
        for a, k, b, v in found:
            keys = {(0, k, v), (1, k, v.split("@")[1] if k == 0 else v.rsplit(".", 1)[0])}
            held.setdefault(t, set()).update(keys)
            pairs |= {(key, w) for key in keys for s, e, w in places if len(w) >= 3 and a - sanitise.CONTEXT <= s and e <= b + sanitise.CONTEXT}
        n_e.update(held.get(t, ()))
        n_et.update(pairs)
        for p in pairs:
            texts.setdefault(p, set()).add(t)
        every[t] = places
    told = set()
    for (key, w), x in n_et.items():
        if len(texts[key, w]) >= (sanitise.SUPPORT, sanitise.GROUP_SUPPORT)[key[0]] and n_e[key] < n:
            if math.log(n * x / (n_e[key] * n_t[w])) >= share * math.log(n / n_e[key]):
                told.add((key, w))
    return {t: {(s, e) for s, e, w in every[t] if any((k, w) in told for k in keys)} for t, keys in held.items()}


def planted_corpus(rng, texts):
    """Documents of the small table and messages of agents, each known by name and desk where the own address stands; the planted words."""
    rows, planted = list(texts), set()
    common = "please call about the order as it was sent on monday and again with new notes from them".split()
    for i in range(40):
        name, desk = f"Zor{i:02d}blatt", f"desk-{i:02d}x"
        for k in range(rng.randint(2, 4)):
            w = rng.choices(common, k=rng.randint(8, 20))
            w.insert(rng.randrange(len(w)), name)
            w.insert(rng.randrange(len(w)), f"agent{i}@mail{i % 3}.example.org" if i % 2 else f"10.0.{i}.7")
            w.insert(rng.randrange(len(w)), desk)
            rows.append((10**6 + 10 * i + k, " ".join(w)))
        planted |= {name.lower(), desk}
    return rows, planted


def test_disclosing_terms_like_brute_force(spark, texts):
    rng = random.Random(3)
    rows, planted = planted_corpus(rng, texts)
    rows += [(5, rows[-1][1]), (6, rows[-1][1]), (None, rows[-2][1]), (None, None), (7, "")]
    got = sanitise.sanitisation(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = told_by_hand(rows)
    assert len(got) == len(rows)
    for r in got:
        assert {(t.start, t.stop) for t in r.terms} == wanted.get(r.text, set()), r.text[:80]
    # against the planted words: all words of the messages that were marked, and those that should be
    for share, least in ((0.5, 0.5), (sanitise.SHARE, 0.9)):
        marked, there = [], []
        for t, spans in told_by_hand(rows, share).items():
            marked += [t[a:b].lower() in planted for a, b in spans]
            there += [w.lower() in planted and any(t[a:b] == w for a, b in spans) for w in t.split() if w.lower() in planted]
        assert sum(marked) >= least * len(marked) and sum(there) >= 0.9 * len(there)


def test_disclosing_terms(spark, odd, odd_rows, none):
    rows = [(i, f"Filler{i} words{i} here{i}. Contact agent Zorblatt at zor@example.com about case{i % 2} today{i} thanks") for i in range(6)]
    rows += [(100 + i, f"the plain agent text number {i} about nothing at all thanks contact") for i in range(40)] + [(None, None), (7, "")]
    out = sanitise.sanitisation(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.where("size(base) > 0").select(F.expr("transform(terms, t -> t.value)").alias("t"), "sanitised").collect()
    assert len(got) == 6
    assert all("zorblatt" in r.t and "agent" not in r.t and "about" not in r.t for r in got)
    assert all("[EMAIL]" in r.sanitised and "Zorblatt" not in r.sanitised and "agent" in r.sanitised for r in got)
    assert out.where("size(base) = 0 and size(terms) > 0").count() == 0
    by_text = {r.text: r for r in sanitise.sanitisation(odd).collect()}
    assert set(by_text) == {t or "" for _, t in odd_rows} and all(listed_here(r) == base_of(t) for t, r in by_text.items())
    assert all(r.sanitised == t for t, r in by_text.items() if not r.base)
    assert sanitise.sanitisation(odd).count() == len(odd_rows)
    assert sanitise.sanitisation(none).count() == 0


def listed_here(r):
    return ",".join(f"{sanitise.KINDS[s.kind]}:{s.start}:{s.stop}" for s in r.base)


def test_long_texts_cost_in_proportion(spark):
    """Half a million numbers, and ten thousand addresses: neither is held against itself."""
    rows = [(1, " ".join(str(10_000 + i % 89_999) for i in range(500_000))), (2, " ".join(f"u{i}@m.org w{i}" for i in range(10_000)))]
    began = time.monotonic()
    got = {r.doc_id: r for r in sanitise.sanitisation(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("base").alias("n"), "sanitised").collect()}
    assert time.monotonic() - began < 120
    assert got[1].n == 0 and got[1].sanitised == rows[0][1]
    assert got[2].n == 10_000 and got[2].sanitised == " ".join(f"[EMAIL] w{i}" for i in range(10_000))


# --- lines


def lines_removed(rows, min_words=line_dedup.MIN_WORDS, min_chars=line_dedup.MIN_CHARS):
    norm = lambda s: " ".join(re.split(r"[\t\x0b\f\r ]+", s)).strip(" ").lower()
    first, out = {}, {}
    every = [(i if i is not None else 1 << 63, n, norm(s)) for i, t in rows for n, s in enumerate((t or "").split("\n"))]
    for i, n, s in every:
        if s:
            first[s] = min(first.get(s, (i, n)), (i, n))

    def one_edit(a, b):
        by_words = [len(x.split(" ")) >= min_words for x in (a, b)]
        if by_words[0] != by_words[1] or not by_words[0] and min(len(a), len(b)) < min_chars:
            return False
        if by_words[0]:
            a, b = a.split(" "), b.split(" ")
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        q = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
        return p + q >= max(len(a), len(b)) - 1

    near = {a for a in first if any(first[b] < first[a] and one_edit(a, b) for b in first if a != b)}
    for i, n, s in every:
        if s and ((i, n) > first[s] or s in near):
            out.setdefault((i, n), s)
    return out


@pytest.mark.parametrize("emit_all", [False, True])
def test_lines_like_brute_force(spark, emit_all):
    rng = random.Random(4)
    base = [" ".join(rng.choices("the quick brown fox jumps over a lazy dog and so on".split(), k=rng.randint(8, 14))) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = rng.choice([[], ["new"], ["other"]])
            lines.append("  ".join(w))
        for _ in range(rng.randint(0, 4)):  # short lines and their typing errors
            t = rng.choice(["see the notes on page twelve", "äöü in a short line é😀", "twenty characters ok", "nineteen characters"])
            k = rng.randrange(len(t))
            lines.append(t[:k] + rng.choice(["", t[k], "x", t[k] + "y"]) + t[k + 1 :])
        rows.append((i, "\n".join([*lines, ""])))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), emit_all=emit_all).collect()
    wanted = lines_removed(rows)
    assert {(r.doc_id, n) for r in got for n in r.removed} == set(wanted)
    assert sum(r.n_near for r in got) > 5
    assert all(r.text == "\n".join(x for n, x in enumerate(dict(rows)[r.doc_id].split("\n")) if (r.doc_id, n) not in wanted) for r in got)


def test_long_lines_cost_in_proportion(spark):
    """Near copies of 300,000 characters without a space, and of 300,000 words: one character replaced, one word left out."""
    rng = random.Random(5)
    a, w = "".join(rng.choices("abcdefghij", k=300_000)), [str(rng.randrange(10**6)) for _ in range(300_000)]
    texts = [a, a[:100_000] + "z" + a[100_001:], " ".join(w), " ".join(w[:150_000] + w[150_001:]), "".join(rng.choices("abcdefghij", k=300_000))]
    started = time.time()
    for emit_all in (False, True):
        got = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), emit_all=emit_all).select("doc_id", "n_near").collect()
        assert sorted((r.doc_id, r.n_near) for r in got) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
    assert time.time() - started < 120


def test_lines_against_sql(spark, data, duck, rows_of):
    assert rows_of(op6_line_dedup(spark, data).toArrow()) == rows_of(duck.sql(OP6).to_arrow_table())


def test_lines_of_odd_rows(spark, odd, odd_rows, none):
    got = line_dedup.line_dedup(odd)
    assert got.count() == len(odd_rows)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.n_lines for r in by_id[1] + by_id[2] + by_id[3]] == [0, 0, 0]
    assert all(r.n_exact == 1 for r in by_id[6] if r.n_lines and "another" not in r.text and r.text == "")
    assert by_id[15][0].removed == [1, 2, 3, 4] and by_id[5][0].removed == []
    out = line_dedup.deduplicated(odd)
    assert out.columns == odd.columns and out.where("n_chars = 0").count() == 3
    assert line_dedup.line_dedup(none).count() == 0 and line_dedup.deduplicated(none).count() == 0


# --- quality


def stats_of(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_statistics(odd_rows, texts):
    rng = random.Random(5)
    for t in [t for _, t in odd_rows + texts] + [" ".join(rng.choices("ab", k=rng.randint(0, 30))) for _ in range(200)]:
        assert quality_rules.text_stats(t)[:5] == stats_of(t)


def test_quality_on_the_table(spark, data, texts):
    got = {r.doc_id: r for r in op7_quality_rules(spark, data).collect()}
    for i, t in texts:
        r, s = got[i], stats_of(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert not (r.base_failed and r.kept)


def test_verdicts_by_hand(spark, texts):
    """kept, rule by rule in plain Python, on documents of which those full of symbols or of short words were labelled bad."""
    rng = random.Random(12)
    rows = [(i, t) for i, t in texts if len((t or "").split()) >= 60]
    bad = [(5000 + i, " ".join(w + rng.choice(["", "#", "|*"]) for w in t.split())) for i, t in rows[:60]]
    bad += [(7000 + i, " ".join("".join(rng.choices("abcdef", k=2)) for _ in range(200))) for i in range(40)]
    good = [(i, t) for i, t in rows[60:]]
    docs = spark.createDataFrame([*good, *bad, (1, None), (2, "few words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules and quality_rules.fit(docs, labels) == rules
    words_in_order = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept, wrong = {r.doc_id: r.kept for r in quality_rules.quality(docs, labels).collect()}, [0, 0]
    for i, t in [*good, *bad, (1, None), (2, "few words")]:
        stats = dict(zip(quality_rules.STATS, quality_rules.text_stats(t), strict=True))
        assert tuple(stats[n] for n in words_in_order) == stats_of(t)

        def share(feature):
            a, b = quality_rules.FEATURES[feature]
            return stats[a] / max(stats[b], 1)

        base = out = stats["n_words"] < 50 or 100 * stats["n_repeat_words"] > 50 * stats["n_words"]
        for rule in rules:
            out = out or all((share(c.feature) > c.threshold) == c.above for c in rule)
        assert kept[i] == (not out)
        wrong[i >= 5000] += not base and kept[i] == (i >= 5000)
    assert wrong[0] <= 0.03 * len(good) and wrong[1] <= 0.4 * len(bad), wrong  # of what the base rules leave to the list


def test_rules_are_learned(spark):
    rng = np.random.default_rng(6)
    n = 3000
    x = {"a": rng.random(n), "b": rng.random(n)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5) | (x["b"] > 0.95)
    rules = quality_rules.learn(x, bad)
    got = np.logical_or.reduce([quality_rules.covers(r, x) for r in rules])
    assert (got == bad).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(n, bool)) == [] and quality_rules.learn(x, np.ones(n, bool)) == []
    stats = {s: rng.integers(0, 100, 500) for s in quality_rules.STATS}
    features = quality_rules.features(stats)
    rules = [(quality_rules.Condition("repeat_share", True, 0.7), quality_rules.Condition("words_per_line", False, 3.0)), (quality_rules.Condition("symbols_per_word", True, 5.0),)]
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in stats.values()], strict=True)), ", ".join(f"{s} long" for s in stats))
    column = [r.x for r in df.select(quality_rules.reject_column(rules).alias("x")).collect()]
    assert column == np.logical_or.reduce([quality_rules.covers(r, features) for r in rules]).tolist()
    assert list(quality_rules.describe(rules))[-1] == "else keep"


def test_held_out_accuracy(spark, duck):
    rows = duck.sql("SELECT d.text, l.quality FROM read_parquet('/root/testdata/sf0.1/documents.parquet') d JOIN read_parquet('/root/testdata/sf0.1/labels.parquet') l USING (doc_id) ORDER BY hash(d.doc_id)").fetchall()
    s = np.array([quality_rules.text_stats(t) for t, _ in rows])
    stats, bad = dict(zip(quality_rules.STATS, s.T, strict=True)), np.array([q == 0 for _, q in rows])
    half = len(rows) // 2
    x, base = quality_rules.features(stats), quality_rules.base_failed_rows(stats)
    cut = lambda sl: ({f: v[sl][~base[sl]] for f, v in x.items()}, bad[sl][~base[sl]])
    rules = quality_rules.learn(*cut(slice(0, half)))
    tx, ty = cut(slice(half, None))
    got = np.logical_or.reduce([quality_rules.covers(r, tx) for r in rules])
    assert (got & ~ty).sum() <= 0.01 * (~ty).sum() and (got & ty).sum() >= 0.9 * ty.sum()


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (99, 0)], "doc_id long, quality int")
    out = quality_rules.quality(odd, labels)
    assert out.count() == len(odd_rows) and out.where("n_words = 0 and kept").count() == 0
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((i, *(w := stats_of(t)), w[0] < 50 or 100 * w[4] > 50 * w[0]) for i, t in odd_rows), key=str)
    assert quality_rules.filtered(odd, labels).columns == odd.columns
    assert quality_rules.quality(none, labels).count() == 0 and quality_rules.quality(odd, labels.limit(0)).count() == len(odd_rows)


# --- sentence spans


def spans_removed(rows):
    first = {}
    every = [(i if i is not None else 1 << 63, b, e, h) for i, t in rows for b, e, h in sentence_spans.runs(t or "")]
    for i, b, _, h in every:
        first[h] = min(first.get(h, (i, b)), (i, b))
    out = {}
    for i, b, e, h in every:
        if (i, b) > first[h]:
            out.setdefault(i, set()).update(range(b, e))
    return out


def test_sentences_keep_the_text(texts, odd_rows):
    for _, t in texts + odd_rows:
        assert "".join(sentence_spans.sentences(t or "")) == (t or "")


def test_spans_on_the_table(spark, data, texts):
    wanted, text = spans_removed(texts), dict(texts)
    for r in op9_sentence_spans(spark, data).collect():
        gone = wanted.get(r.doc_id, set())
        parts = sentence_spans.sentences(text[r.doc_id])
        assert r.removed == ",".join(map(str, sorted(gone))) and r.n_sentences == len(parts)
        assert r.text_sha256 == sha("".join(p for i, p in enumerate(parts) if i not in gone))


@pytest.mark.parametrize(("window", "min_sentences", "min_words"), [(3, 2, 20), (2, 3, 6), (3, 2, 0), (60, 1, 5)])
def test_runs_by_definition(texts, odd_rows, window, min_sentences, min_words):
    """Begins and ends from sums of words are those of trying every run; the pattern of stops has the places of its plain form."""
    plain = re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？][”’」』]*\s*|\n\s*")
    least = min_sentences if min_sentences > 2 else 1
    for _, t in texts[:25] + odd_rows:
        t = (t or "")[:1500]
        assert [m.span() for m in plain.finditer(t)] == [m.span() for m in sentence_spans.END.finditer(t)]
        parts = [(i, w) for i, s in enumerate(sentence_spans.sentences(t)) if (w := s.lower().split())]
        many = lambda b, e: 0 <= b and e <= len(parts) and e - b >= least and sum(len(w) for _, w in parts[b:e]) >= min_words  # noqa: B023, E731
        wanted = {}
        for b in range(len(parts)):
            for e in range(b + 1, len(parts) + 1):
                short = many(b, e) and (not many(b + 1, e) or not many(b, e - 1)) or e - b == 1 and len(parts[b][1]) >= min_words
                if e - b == window or min_words and short:
                    wanted[parts[b][0], parts[e - 1][0] + 1] = " ".join(x for _, w in parts[b:e] for x in w)
        assert [(b, e, h) for b, e, h in sentence_spans.runs(t, window, min_sentences, min_words)] == [(*at, xxhash.xxh3_128_digest(wanted[at].encode())) for at in sorted(wanted)]


def test_repeated_passage_goes(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(5, 14))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(7))
    rows = [(i, " ".join([sentence(), sentence(), passage, sentence()])) for i in range(5)]
    out = {r.doc_id: r for r in sentence_spans.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_removed == 0 and all(out[i].n_removed >= 6 for i in range(1, 5))


def repeated_sentences(rows, window=3, min_words=20):
    """Numbers of the sentences that lie in a run of window sentences or min_words words whose like stands earlier, found by growing equal pairs, without runs()."""
    flat = [(i, k, w) for i, t in sorted(rows) for k, s in enumerate(sentence_spans.sentences(t or "")) if (w := s.lower().split())]
    like, out = {}, {}
    same = lambda a, b: 0 <= a and b < len(flat) and flat[a][2] == flat[b][2]
    for b, (i, _, w) in enumerate(flat):
        for a in like.setdefault(tuple(w), []):
            if same(a - 1, b - 1) and flat[a - 1][0] == flat[a][0] and flat[b - 1][0] == i:
                continue  # not the begin of an equal stretch
            n = 1
            while same(a + n, b + n) and flat[a + n][0] == flat[a][0] and flat[b + n][0] == i:
                n += 1
            if n >= window or min_words and sum(len(flat[b + k][2]) for k in range(n)) >= min_words:
                out.setdefault(i, set()).update(flat[b + k][1] for k in range(n))
        like[tuple(w)].append(b)
    return out


def words_of(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def test_whole_passage_goes(spark, data, texts):
    """The last sentences of a repeated passage too, like an independent brute force."""
    rng = random.Random(9)
    three = ". ".join(words_of(rng, n) for n in (15, 15, 3)) + ". "
    seven = ". ".join(words_of(rng, rng.randint(3, 14)) for _ in range(7)) + ". "
    rows = [(i, "".join([words_of(rng, 9) + ". ", three, words_of(rng, 30) + ". ", seven, words_of(rng, 4) + "."])) for i in range(4)]
    out = {r.doc_id: r for r in sentence_spans.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].removed for i in range(4)] == [[], *[[1, 2, 3, *range(5, 12)]] * 3]
    wanted = repeated_sentences(texts)
    assert {r.doc_id: r.removed for r in op9_sentence_spans(spark, data).collect() if r.removed} == {i: ",".join(map(str, sorted(s))) for i, s in wanted.items()}


@pytest.mark.parametrize("window", [2, 3, 5])
def test_windows_alone(spark, window):
    """Runs of short sentences, without the bound on words, like brute force."""
    rng = random.Random(window)
    pool = [f"Say {w}." for w in "abc"] + [words_of(rng, 25) + "."]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(30)]
    out = sentence_spans.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window, min_words=0).collect()
    wanted = repeated_sentences(rows, window, 0)
    assert {r.doc_id: r.removed for r in out if r.removed} == {i: sorted(s) for i, s in wanted.items()} and wanted


def test_passage_without_neighbours_goes(spark):
    """One long sentence, a text without stops, and a stretch of such a text."""
    rng = random.Random(10)
    lone, stopless, part = words_of(rng, 55), "\u0964 ".join(words_of(rng, 30) for _ in range(4)), words_of(rng, 200)
    short = words_of(rng, 25) + ". "
    rows = [(2 * i + k, t) for i in range(3) for k, t in enumerate((f"{words_of(rng, 8)}. {lone}. {short}{words_of(rng, 9)}.", f"{words_of(rng, 60 + i)} {part} {words_of(rng, 60)}"))]
    rows += [(i, stopless) for i in (6, 7)] + [(i, "again " * 120) for i in (8, 9)]
    out = {r.doc_id: r for r in sentence_spans.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_removed == 0 for i in (0, 1, 6)) and out[7].text == "" and not out[9].text.strip()
    for i in (2, 4):
        assert not set(lone.split()) & set(out[i].text.replace(".", "").split()) and short not in out[i].text
    for i in (3, 5):
        left = set(out[i].text.split())
        assert sum(w in left for w in part.split()) <= 50 and len(left - set(part.split())) >= 100


def test_spans_of_odd_rows(spark, odd, odd_rows, none):
    """Rows of repeated and null ids too: a run counts as repeated behind its first place, whatever row it stands in."""
    rows = sentence_spans.substring_dedup(odd).collect()
    assert len(rows) == len(odd_rows) and sentence_spans.substring_dedup(none).count() == 0
    order = lambda i: i if i is not None else 1 << 63
    first = {}
    for i, t in odd_rows:
        for b, _, h in sentence_spans.runs(t or ""):
            first[h] = min(first.get(h, (order(i), b)), (order(i), b))
    wanted = []
    for i, t in odd_rows:
        gone = {k for b, e, h in sentence_spans.runs(t or "") if (order(i), b) > first[h] for k in range(b, e)}
        parts = sentence_spans.sentences(t or "")
        wanted.append((i, len(parts), tuple(sorted(gone)), "".join(p for k, p in enumerate(parts) if k not in gone)))
    assert sorted(((r.doc_id, r.n_sentences, tuple(r.removed), r.text) for r in rows), key=str) == sorted(wanted, key=str)


def test_long_text_of_one_sentence_again_and_again(spark):
    """Half a million words without a repeated document; and two documents that share it all."""
    rng = random.Random(11)
    long = ". ".join(words_of(rng, 12) for _ in range(40_000))
    out = {r.doc_id: r for r in sentence_spans.substring_dedup(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[1].text == long and not out[2].text.strip()


def test_sanitisation_of_a_group_that_half_of_the_texts_share(spark, monkeypatch):
    """A mail domain in half of the documents: the rows made are in proportion to the words of its holders."""
    made = {}
    plain = sanitise.written

    def spied(df, tag, last=False):
        out = plain(df, tag, last)
        made[tag] = made.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(sanitise, "written", spied)
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(400)]
    rows = []
    for i in range(600):
        own = " ".join(rng.choices(words, k=12))
        rows.append((i, f"desk{i % 97:02d}x {own} user{i}@mail.example wrote" if i % 2 else own))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sanitise.sanitisation(df, share=0.05, group_support=2)
    assert got.where("size(terms) > 0").count() > 0
    assert made["wanted"] <= made["places"] <= 300 * 16
