"""Repair of damaged conversations by the cheapest edits that make their roles ``(s?(ua)+)?``.

The dynamic programme runs over retained turns. A turn is kept or given another role; what lies between two retained turns is
deleted, at the difference of two prefix sums of deletion costs, so that for each role of the turn before only the running
minimum of "cost minus prefix sum" matters. The pair of roles decides how many turns have to be inserted between them. Equal
costs are decided by the least audit, the string of the edits' initials.

Conversations of any length: rows are dealt by ranges of (conversation, turn), not by conversation. A part of a conversation that
ends at a border of a partition, or at CHUNK rows, is summed up by its cheapest edits for every role before it and after it; these
sums are joined by a stream that then passes the texts once, in order. What that stream holds is audits, a character for each row;
a digest of a whole conversation can't be made but in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tessavox.llm.common import pick, tidy, written

#: Costs of the edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation that are summed up together.
CHUNK = 4096
#: States: the initial of the last retained turn's role, "" before the first one.
STATES = ("", "s", "u", "a")
#: Turns to insert before a retained turn of the second role, after the first; pairs that aren't here can't be.
BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Turns to insert at the end.
AFTER = {"": 0, "s": 2, "u": 1, "a": 0}
#: The role that is put in, or that a turn is given, after each state.
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}

Best = dict[str, tuple[int, str]]
_BLANK = r"^[\x20\x09-\x0D]*\z"
_CUT_OFF = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"


def edits(rows: Iterable[tuple[str, bool, bool, int]], start: str = "") -> Best:
    """The least cost and audit for each state after the rows (initial, deleted at any rate, truncated, copies), from one state before them.

    Further copies of a row repeat it and so are deleted.
    """
    least: dict[str, tuple[int, str, int]] = {start: (0, "", 0)}  # cost less the prefix sum, audit, rows up to its end
    at = sums = 0
    for initial, gone, cut, copies in rows:
        found: dict[str, tuple[int, str]] = {}
        if not gone:
            extra = TRUNCATED if cut else 0
            turns = [(r, REROLE + extra, "R") for r in "ua" if r != initial]
            if initial and initial in "sua":
                turns.append((initial, extra, "K"))
            for role, price, letter in turns:
                for state, (cost, audit, end) in least.items():
                    inserted = BETWEEN.get((state, role))
                    if inserted is None:
                        continue
                    total = cost + sums + INSERT * inserted + price
                    old = found.get(role)
                    if old is None or total <= old[0]:
                        new = total, audit + "D" * (at - end) + "I" * inserted + letter
                        if old is None or new < old:
                            found[role] = new
        at += 1
        sums += DELETE
        for role, (cost, audit) in found.items():
            old = least.get(role)
            if old is None or (cost - sums, audit) < (old[0], old[1] + "D" * (at - old[2])):
                least[role] = cost - sums, audit, at
        at += copies - 1
        sums += DELETE * (copies - 1)
    return {s: (cost + sums, audit + "D" * (at - end)) for s, (cost, audit, end) in least.items()}


def joined(before: Best, part: dict[str, Best]) -> Best:
    """The least cost and audit for each state after one more part."""
    out: Best = {}
    for s, (cost, audit) in before.items():
        for t, (more, rest) in part.get(s, {}).items():
            new = cost + more, audit + rest
            if t not in out or new < out[t]:
                out[t] = new
    return out


def whole_audit(best: Best) -> tuple[int, str]:
    """The least cost and audit at the end of a conversation."""
    return min((cost + INSERT * AFTER[s], audit + "I" * AFTER[s]) for s, (cost, audit) in best.items())


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def _slim(rows: DataFrame) -> DataFrame:
    """One row for rows that are the same: its faults, its number of copies, and whether it is the first with its role and text."""
    same = rows.where("copies > 0").select("conv", "turn", "role", "digest", F.col("text").rlike(_BLANK).alias("blank"), F.col("text").rlike(_CUT_OFF).alias("cut"), "copies")
    same = same.groupBy("conv", "turn", "role", "digest").agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.sum("copies").alias("copies"))
    # of (known, turn) a null turn's is the least
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = same.groupBy(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_")).agg(F.min(place).alias("first"))
    on = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    return same.join(first, on).select("conv", "turn", "role", "digest", "blank", "cut", "copies", place.eqNullSafe(F.col("first")).alias("fresh"))


_PART = "number long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, first string, last string, low long, high long, turns long, edits array<struct<start string, state string, cost long, audit string>>"


def _parts(slim: DataFrame) -> DataFrame:
    """The sums of every part of a conversation that lies in one partition."""
    conv = slim.schema["conv"].dataType.simpleString()
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        number, opened = 0, True

        def rows():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        def part(group: list[tuple], whole: bool) -> dict:
            initials = [r[2][:1] for r in group]
            turns = [r[1] for r in group if r[1] is not None]
            pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            blank = sum(r[6] for r in group if r[4])
            doubled = sum(r[6] - r[7] for r in group if not r[4])
            cut = sum(r[7] and r[5] for r in group if not r[4])
            todo = [(i, r[4] or not r[7], r[5], r[6]) for i, r in zip(initials, group, strict=True)]
            found = [(s, t, cost, audit) for s in (STATES[:1] if whole else STATES) for t, (cost, audit) in edits(todo, s).items()]
            return {
                "conv": group[0][0], "number": number, "n_blank": blank, "n_duplicate": doubled, "n_truncated": cut,
                "n_illegal": pairs + sum(r[6] - 1 for r in group), "first": initials[0], "last": initials[-1],
                "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
                "edits": [dict(zip(("start", "state", "cost", "audit"), x, strict=True)) for x in found],
            }

        out: list[dict] = []
        for _, same in groupby(rows(), key=lambda r: r[0]):
            starts, group = not opened, []  # the partition's first conversation may have begun in another one
            opened = False
            for r in same:
                if len(group) == CHUNK:
                    out.append(part(group, starts))
                    number, group, starts = number + 1, [], False
                group.append(r)
            out.append(part(group, starts))
            number += 1
            if len(out) >= 512:
                yield out
                out = []
        yield out

    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv", "turn", "role", "digest", "blank", "cut", "copies", "fresh").mapInArrow(_typed(summed, dealt, _PART), f"conv {conv}, {_PART}").withColumn("part", F.spark_partition_id())


def _typed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[list[dict]]], df: DataFrame, fields: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, with the rows that it makes in batches of the output's Arrow types."""
    rest = StructType.fromDDL(fields)
    schema = to_arrow_schema(StructType([StructField("conv", df.schema["conv"].dataType), *rest.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in f(batches):
            yield pa.RecordBatch.from_pylist(made, schema)

    return run


class _Conversation:
    """What the stream of one conversation's parts and rows comes to."""

    def __init__(self, conv):
        self.conv, self.best, self.sums = conv, {"": (0, "")}, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last = self.cost = None
        self.state, self.at, self.lines, self.sha = "", 0, 0, hashlib.sha256()

    def part(self, p: dict) -> None:
        s = self.sums
        s["illegal"] += p["n_illegal"] + (self.last is not None and self.last + p["first"] not in ("su", "ua", "au"))
        s["blank"], s["duplicate"], s["truncated"] = s["blank"] + p["n_blank"], s["duplicate"] + p["n_duplicate"], s["truncated"] + p["n_truncated"]
        s["turns"] += p["turns"] - (p["low"] is not None and p["low"] == self.high)
        self.last = p["last"]
        self.low = p["low"] if self.low is None else self.low
        self.high = self.high if p["high"] is None else p["high"]
        table: dict[str, Best] = {}
        for e in p["edits"]:
            table.setdefault(e["start"], {})[e["state"]] = e["cost"], e["audit"]
        self.best = joined(self.best, table)

    def settle(self) -> None:
        if self.cost is None:
            self.cost, self.audit = whole_audit(self.best)

    def put(self, edit: str, role: str | None = None, text: str = "") -> dict:
        role = NEXT[self.state] if role is None else role
        self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.state, self.lines = role[:1], self.lines + 1
        return {"conv": self.conv, "position": self.lines - 1, "role": role, "text": text, "edit": edit}

    def inserts(self) -> Iterator[dict]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.put("I")

    def row(self, role: str, text: str, copies: int) -> Iterator[dict]:
        """The repaired messages up to this row's."""
        self.settle()
        for _ in range(copies):
            yield from self.inserts()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit != "D":
                yield self.put(edit, role if edit == "K" else None, text)

    def end(self) -> Iterator[dict]:
        self.settle()
        yield from self.inserts()

    def summary(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return {"conv": self.conv, "gaps": gaps, **{k: self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.sha.hexdigest()}


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_MESSAGES = "position long, role string, text string, edit string"


def _stream(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None, summaries: bool) -> DataFrame:
    names = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col} | ({"copies": copies_col} if copies_col else {})
    rows = pick(messages, **names)
    text = _filled("text")
    copies = F.col("copies").cast("long") if copies_col else F.lit(1).cast("long")
    rows = rows.select("conv", F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), copies.alias("copies"))
    with tidy(messages.sparkSession):
        parts = written(_parts(written(_slim(rows), "turns")), "parts", last=True)
    fields = [f for f in parts.columns if f not in ("conv", "part", "number")]
    late = ["turn", "role", "text", "digest", "copies"]
    sums = parts.select("conv", F.lit(0).alias("kind"), "part", "number", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in late], F.struct(*fields).alias("sums"))
    nulls = F.lit(None)
    lines = rows.select("conv", F.lit(1).alias("kind"), nulls.cast("int").alias("part"), nulls.cast("long").alias("number"), *late, nulls.cast(sums.schema["sums"].dataType).alias("sums"))
    both = sums.union(lines).repartition("conv").sortWithinPartitions("conv", "kind", "part", "number", F.col("turn").asc_nulls_first(), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        now, out, size = None, [], 0

        def close() -> None:
            nonlocal size
            made = list(now.end())
            out.extend([now.summary()] if summaries else made)
            size += len(now.audit) if summaries else 0

        for b in batches:
            for conv, kind, role, line, copies, part in zip(*[b.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "copies", "sums")], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        close()
                    now = _Conversation(conv)
                if kind == 0:
                    now.part(part)
                    continue
                for message in now.row(role, line, copies):
                    if not summaries:
                        out.append(message)
                        size += len(message["text"])
                if len(out) >= 1000 or size >= 1 << 22:
                    yield out
                    out, size = [], 0
        if now is not None:
            close()
        yield out

    conv = rows.schema["conv"].dataType.simpleString()
    made = _SUMMARY if summaries else _MESSAGES
    done = both.select("conv", "kind", "role", "text", "copies", "sums").mapInArrow(_typed(run, rows, made), f"conv {conv}, {made}")
    return done.withColumnRenamed("conv", conv_col)


def repaired(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand in the order of their turns, null ones first; ties by role, then by the MD5 of the text, so equal rows are neighbours.
    Nulls of role and text count as one space. A null conversation id is a conversation of its own. Copies, where given, say how
    often a row stands there; with 0 the row is gone, but its conversation stays known. A conversation without rows has zeros, an
    empty audit and the digest of the empty string; an empty table gives none. Texts may be of any length, extra columns are ignored.
    """
    return _stream(messages, conv_col, turn_col, role_col, text_col, copies_col, True)


def repaired_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """The repaired conversations themselves: conversation, position from 0, role, text, and the edit (K, R or I) that left it; rows as in ``repaired``."""
    return _stream(messages, conv_col, turn_col, role_col, text_col, copies_col, False)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: damage by the CRC-32 of "conv_id:turn" modulo 20 (nulls one space).

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.withColumn("fault", F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(_filled("text"), ".!?", "")).otherwise(_filled("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(_filled("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))
