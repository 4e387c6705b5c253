"""Repaired conversations against an exhaustive search, over cuts of long ones, and on odd rows."""

import functools
import random
import zlib
from hashlib import md5, sha256

import pytest

from tessavox.llm import conversation_repair as repair
from tessavox.llm.queries import OP11, op11_conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def slow(rows):
    """rows: (turn, role, text) after damage. Every edit at every place, the least (cost, audit) by recursion from the end."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserts):
        """(cost, audit, lines) of the rest, lines as a tuple; state: initials so far, only the last one matters."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def after(initial):
            return {"": initial in ("s", "u"), "s": initial == "u", "u": initial == "a", "a": initial == "u"}[state]

        def way(cost, letter, line, initial, j, n):
            if after(initial):
                rest = best(j, initial, n)
                if rest:
                    ways.append((cost + rest[0], letter + rest[1], (line, *rest[2])))

        if inserts < 3:
            for role in ("user", "assistant"):
                way(5, "I", f"{role}:", role[0], i, inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            rest = best(i + 1, state, 0)
            if rest:
                ways.append((2 + rest[0], "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                way(extra, "K", f"{role}:{text}", role[:1], i + 1, 0)
                for other in ("user", "assistant"):
                    way(1 + extra, "R", f"{other}:{text}", other[0], i + 1, 0)
        return min(ways, default=None, key=lambda w: w[:2])

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def slow_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1))
    return out


def some(rng, n):
    return [(rng.choice([None, *range(6)]) if rng.random() < 0.3 else k, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "]), rng.choice(["Yes.", "No!", "half", "", "  ", "Well? ", "x\n", "Ü."])) for k in range(n)]


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 3)


@pytest.mark.parametrize("seed", range(40))
def test_parts_join_to_the_whole(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suat") if rng.random() < 0.9 else "", rng.random() < 0.2, rng.random() < 0.3, rng.choice([1, 1, 1, 3])) for _ in range(14)]
    cuts = sorted(rng.sample(range(15), 3))
    best = {"": (0, "")}
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        best = repair.joined(best, {s: repair.edits(rows[a:b], s) for s in repair.STATES})
    assert repair.whole_audit(best) == repair.whole_audit(repair.edits(rows))


def test_against_every_edit(spark, small_chunks):
    rng = random.Random(3)
    all_rows = {c: some(rng, rng.randint(1, 9)) for c in range(150)}
    df = spark.createDataFrame([(c, *r) for c, rows in all_rows.items() for r in rows], "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(df.repartition(5)).collect()}
    assert got == {c: slow(rows) for c, rows in all_rows.items()}


def test_the_table(spark, duck, data, rows_of):
    raw = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = op11_conversation_repair(spark, data)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: slow(rows) for c, rows in slow_damage(raw).items()}
    assert rows_of(got.toArrow()) == rows_of(duck.execute(OP11).to_arrow_table())


def test_messages_are_what_the_digest_says(spark, data):
    df = repair.damaged(spark.read.parquet(f"{data}/conversations.parquet"))
    digests = {r.conv_id: (r.repaired_sha256, r.audit) for r in repair.repaired(df, copies_col="copies").collect()}
    found = {}
    for r in repair.repaired_messages(df, copies_col="copies").orderBy("conv_id", "position").collect():
        found.setdefault(r.conv_id, []).append(r)
    for c, (sha, audit) in digests.items():
        lines = found.get(c, [])
        assert sha256("\n".join(f"{m.role}:{m.text}" for m in lines).encode()).hexdigest() == sha
        assert "".join(m.edit for m in lines) == audit.replace("D", "")
        assert [m.position for m in lines] == list(range(len(lines)))


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", None), (1, None, "user", None), (1, 2, "", "."), (2, 7, "assistant", "x" * 300_000 + "."), (2, 7, "assistant", "x" * 300_000 + "."), (3, -5, "system", "Only."), (4, 0, "User", "Case."), (5, 1, "user", "é" * 10 + "?"), (5, 9, "sage", "S.")]
    schema = "kind string, conv_id long, part string, turn long, role string, text string, copies string, conv string, sums string"
    df = spark.createDataFrame([("?", c, "?", t, r, x, "?", "?", "?") for c, t, r, x in rows], schema)
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(repair.damaged(df), copies_col="copies").collect()}
    assert got == {c: slow(r) for c, r in slow_damage(rows).items()}


def test_conversation_whose_rows_are_all_dropped_and_empty_table(spark):
    t = next(t for t in range(1000) if zlib.crc32(f"77:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(77, t, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repaired(repair.damaged(df), copies_col="copies").collect()] == [(77, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    assert repair.repaired(repair.damaged(df.limit(0)), copies_col="copies").count() == 0


def test_one_long_conversation_over_many_partitions(spark, monkeypatch):
    """A conversation that doesn't fit in a chunk is dealt to several partitions and gives what one run of the programme gives."""
    monkeypatch.setattr(repair, "CHUNK", 50)
    rng = random.Random(9)
    rows = [(k // 2, rng.choice(["user", "assistant", "system"]), f"Say {rng.randint(0, 300)}" + rng.choice([".", ""])) for k in range(3000)]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    ordered = sorted(rows, key=lambda r: (r[0], r[1].encode(), md5(r[2].encode()).digest()))
    seen, todo = set(), []
    for _, role, text in ordered:
        todo.append((role[0], (role, text) in seen, not text.endswith("."), 1))
        seen.add((role, text))
    got = repair.repaired(df).where("conv_id = 1").first()
    assert (got.cost, got.audit) == repair.whole_audit(repair.edits(todo))
    assert got.gaps == 0 and got.duplicate == sum(t[1] for t in todo)
