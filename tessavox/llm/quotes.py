"""Quotation linking for chat formatting: which earlier message a message quotes, and conversations in the order of replies.

A line's quote level is the number of ``>`` before its text. Lines of one level in a row are a passage; passages are
hashed as lower-cased words, whole and by line, and joined to the messages of the same conversation in
whose own words the same passage or line stands. The link goes to the earliest such message; shallow levels count
before deep ones and whole passages before lines. Links always point to earlier turns, so they form trees;
roots and depths come from doubling the links, a few rounds whatever the depth.

A conversation in reply order is the walk through its trees: each message, then the replies to it with all that answers
them, replies of one message in turn. The places on that walk are ranked by doubling too, on rows of a few numbers
with keys of their own, so neither a long thread nor a message with many replies gathers in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessavox.llm.common import drop, pick, small, tidy, whole, written

#: Marks of a quoted line, and the line that announces a quotation (a clause with a date, or a name alone).
QUOTED = re.compile(r"[ \t]*((?:>[ \t]*)+)(.*)", re.DOTALL)
ANNOUNCED = re.compile(r"(?i)^\s*(?:(?:on|am|le|el)\b.{1,200}\b|\S{1,60}(?: \S{1,60}){0,5} )(?:wrote|schrieb|écrit|escribió)\s*:\s*$")
#: Turns of one message's replies in a bucket, where the next reply is looked up.
BUCKET = 4096


def parse(text: str) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """The message's own lines, and its quoted passages with their levels.

    A line that announces a quotation right below it, or below blank lines, belongs to it and is dropped.
    """
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    level_before = 0
    for line in text.split("\n"):
        m = QUOTED.fullmatch(line)
        level = m[1].count(">") if m else 0
        if not m:
            own.append(line)
        else:
            if level_before == 0:
                last = len(own) - 1
                while last >= 0 and not own[last].strip():
                    last -= 1
                if last >= 0 and ANNOUNCED.match(own[last]):
                    del own[last:]
            if level == level_before:
                quoted[-1][1].append(m[2])
            else:
                quoted.append((level, [m[2]]))
        level_before = level
    return own, quoted


def _hash(lines: list[str]) -> int | None:
    """Of the words, lower-cased; None without any. 63 bits are enough, as hashes meet within one conversation only."""
    words = " ".join(lines).lower().split()
    return xxhash.xxh3_64_intdigest(" ".join(words).encode()) >> 1 if words else None


def own_text(own: list[str]) -> str:
    """The own lines without blank ones at both ends."""
    first, last = 0, len(own)
    while first < last and not own[first].strip():
        first += 1
    while last > first and not own[last - 1].strip():
        last -= 1
    return "\n".join(own[first:last])


def passages(own: list[str]) -> set[int]:
    """Hashes by which others can quote a message: all of it, its paragraphs, its lines."""
    out, paragraph = {_hash(own)}, []
    for line in [*own, ""]:
        if line.strip():
            paragraph.append(line)
            out.add(_hash([line]))
        elif paragraph:
            out.add(_hash(paragraph))
            paragraph = []
    return {h for h in out if h is not None}


def citations(quoted: list[tuple[int, list[str]]]) -> list[tuple[int, int]]:
    """rank (smaller is better) and hash of each quoted passage and line."""
    out = []
    for level, lines in quoted:
        out.append((2 * level, _hash(lines)))
        if len(lines) > 1:
            out += [(2 * level + 1, _hash([x])) for x in lines]
    return [(r, h) for r, h in dict.fromkeys(out) if h is not None]


PARSED = "conv_id long, turn long, role string, own string, n_quotes long, max_level int, cites array<struct<rank:int,hash:long>>, passages array<long>"


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("rank", pa.int32()), ("hash", pa.int64())])), pa.list_(pa.int64())]
        names = [x.split(" ")[0] for x in PARSED.split(", ")]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                rows = []
                for text in b.column(3).to_pylist():
                    own, quoted = parse(text)
                    rows.append((own_text(own), len(quoted), max([0, *(x[0] for x in quoted)]), [{"rank": r, "hash": h} for r, h in citations(quoted)], sorted(passages(own))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names)

    return messages.mapInArrow(run, PARSED)


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the best earlier message of each that quotes one."""
    cites = written(parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("cites").alias("c")).select("conv_id", "turn", "c.*"), "cites")
    wanted = small(written(cites.select("conv_id", "hash").distinct(), "wanted"))
    stands = parsed.where("turn is not null").select("conv_id", "turn", F.explode("passages").alias("hash")).join(wanted, ["conv_id", "hash"], "left_semi")
    origin = written(stands.groupBy("conv_id", "hash").agg(F.min("turn").alias("parent")), "origins")
    best = cites.join(origin, ["conv_id", "hash"]).where("parent < turn").groupBy("conv_id", "turn").agg(F.min(F.struct("rank", "parent")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.parent").alias("parent"))


def rooted(link: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root, depth of each linked message; every round doubles how far a link reaches."""
    now = written(link.select("*", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "roots")
    while True:
        further = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = now.join(further, (F.col("conv_id") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        before, now = now, written(joined.select("conv_id", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(before)
        if now.where("moved").isEmpty():
            return now.drop("moved")
        before, now = now, written(now.drop("moved"), "roots")
        drop(before)


def _next_replies(tree: DataFrame) -> DataFrame:
    """conv_id, turn, brother: the next reply to the same message, null for its last.

    Looked up within buckets of turns, and for the last of a bucket in the next bucket that has replies.
    """
    rows = tree.select("conv_id", "parent", "turn", F.floor(F.col("turn") / BUCKET).alias("bucket"))
    within = rows.withColumn("near", F.lead("turn").over(Window.partitionBy("conv_id", "parent", "bucket").orderBy("turn")))
    firsts = rows.groupBy("conv_id", "parent", "bucket").agg(F.min("turn").alias("first"))
    later = firsts.withColumn("far", F.lead("first").over(Window.partitionBy("conv_id", "parent").orderBy("bucket"))).drop("first")
    return within.join(later, ["conv_id", "parent", "bucket"]).select("conv_id", "turn", F.coalesce("near", "far").alias("brother"))


def ordered(tree: DataFrame) -> DataFrame:
    """conv_id, turn, position: places of the messages of ``tree`` (of rooted()) and of its roots, from 0 in each thread.

    The walk comes to each message (side 0) and leaves it (side 1) once: from coming to the first reply, or to the
    leaving; from leaving to the next reply of the same message, or to the leaving of that message. Each place learns how
    many messages come after it by doubling the steps.
    """
    roots = tree.select("conv_id", F.col("root").alias("turn")).distinct()
    nodes = tree.select("conv_id", "turn", "parent").union(roots.select("conv_id", "turn", F.lit(None).cast("long"))).join(_next_replies(tree), ["conv_id", "turn"], "left")
    child = tree.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = written(nodes.join(child, ["conv_id", "turn"], "left"), "walk")
    come = nodes.select("conv_id", "turn", F.lit(0).alias("side"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("n"))
    leave = nodes.select("conv_id", "turn", F.lit(1).alias("side"), F.coalesce("brother", "parent").alias("to"), F.when(F.col("brother").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("n"))
    now = written(come.union(leave), "walk")
    # n counts the messages that are come to from here (this one included) up to, and without, the next place
    while not now.where("to is not null").isEmpty():
        further = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("side").alias("s"), F.col("to").alias("to2"), F.col("to_side").alias("side2"), F.col("n").alias("n2"))
        joined = now.join(further, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("t")) & (F.col("to_side") == F.col("s")), "left")
        before, now = now, written(joined.select("conv_id", "turn", "side", F.col("to2").alias("to"), F.col("side2").alias("to_side"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "walk")
        drop(before)
    whose = tree.select("conv_id", "turn", "root").union(roots.select("conv_id", "turn", F.col("turn").alias("root")))
    after = now.where("side = 0").select("conv_id", "turn", "n").join(whose, ["conv_id", "turn"])
    sizes = after.where("turn = root").select("conv_id", "root", F.col("n").alias("all"))
    return after.join(sizes, ["conv_id", "root"]).select("conv_id", "turn", (F.col("all") - F.col("n")).alias("position"))


def linked_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), parent, root, depth, position, n_quotes, max_level, formatted of every message.

    Ordered by (conv_id, root, position) the messages are conversations in the order of replies, thread by thread: each stands
    behind the one it answers, and what answers it before other replies to that one. ``formatted`` is the message in the form
    ``<|role|>`` (``unknown`` for a null role) and its own text. A message that quotes nothing known is its own root at
    depth 0 and position 0; of several earlier messages with the quoted words the earliest counts. Null texts
    are empty. Messages without a conversation or turn link to nothing and have themselves as root. Rows that repeat
    a turn share its link and place. Extra columns are ignored.
    """
    plain = pick(messages, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    plain = plain.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), whole("text").alias("text"))
    parsed = _parsed(plain)
    with tidy(messages.sparkSession):
        tree = rooted(links(parsed))
        places = ordered(tree).withColumnsRenamed({"conv_id": "c", "turn": "t"})
        known = tree.select("conv_id", "turn", "parent", "root", "depth")
        placed = places.join(known, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
        threads = small(written(placed.select("c", "t", "parent", "root", "depth", "position"), "threads", last=True))
    joined = parsed.join(threads, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        "parent",
        F.coalesce("root", "turn").alias("root"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
        "n_quotes",
        F.col("max_level").cast("long").alias("max_level"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own")).alias("formatted"),
    )
