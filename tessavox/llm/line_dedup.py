"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as lower-cased words. Equal lines count as the same, and so do lines that one edit turns into each
other: of a word (replaced, added, left out) between lines of at least ``min_words`` words, of a character between shorter lines
of at least ``min_chars`` characters. The earliest stays. The deletion neighbourhood of a line is the line and
all it becomes with one unit, word or character, left out; two lines within one edit share a member. All members are
emitted as hashed keys and equal keys joined, for every line that can have a neighbour at all: two lines within one edit also
agree in their first or in their last half, so a line whose halves no other different line has emits nothing, unless
``emit_all`` asks for it (the result is the same). The edit distance of each pair is then verified on the units.

A key's lines are never paired with each other: all are held against the earliest one of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import pick, small, tidy, whole, written

MIN_WORDS, MIN_CHARS = 10, 20
#: Fixed value: white space inside a line.
SPACE_CHARS = "\t\v\f\r "
SPACE = f"[{SPACE_CHARS}]+"
_LINES = 10**10  # positions are id * _LINES + line number
_LAST_ID = (1 << 63) - 1


def normal(line: Column) -> Column:
    """Lower-cased words with one space between them; the pattern runs only over lines that need it."""
    bare = F.btrim(line, F.lit(SPACE_CHARS))
    uneven = F.contains(bare, F.lit("  "))
    for c in SPACE_CHARS[:-1]:
        uneven |= F.contains(bare, F.lit(c))
    return F.lower(F.when(uneven, F.regexp_replace(bare, SPACE, " ")).otherwise(bare))


def _position() -> Column:
    """Order of a line's occurrences; rows without an id come last."""
    return (F.coalesce("doc_id", F.lit(_LAST_ID)).cast("decimal(38,0)") * F.lit(_LINES).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(38,0)")


def _n_words() -> Column:
    return F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit(""))) + 1


def _unit(min_words: int, min_chars: int) -> Column:
    """What an edit of ``text`` changes: 1 a word, 2 a character, 0 nothing (such lines only match exactly)."""
    return F.when(_n_words() >= min_words, 1).when(F.char_length("text") >= min_chars, 2).otherwise(0)


def _halves() -> Column:
    """Keys of the first and last units of ``text`` (null without units): lines within one edit have one in common.

    Of n units the first and last n/2 and (n - 1)/2, cut, count: those of the shorter length also come from lines of
    n - 1 units, so lengths may differ by one.
    """

    def keys(unit: int, n: Column, part) -> Column:
        halves = [(F.floor(n / 2).cast("int"), side) for side in (1, -1)] + [(F.floor((n - 1) / 2).cast("int"), side) for side in (1, -1)]
        return F.array_distinct(F.array(*[F.xxhash64(F.lit(unit), F.lit(side), h, part(h, side)) for h, side in halves]))

    words = keys(1, _n_words(), lambda h, side: F.call_function("substring_index", F.col("text"), F.lit(" "), h * side))
    chars = keys(2, F.char_length("text"), lambda h, side: F.substring(F.col("text"), F.lit(1), h) if side > 0 else F.substring(F.col("text"), F.char_length("text") - h + 1, h))
    return F.when(F.col("unit") == 1, words).when(F.col("unit") == 2, chars)


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: doc_id, row_key, line_no, text, h1, h2 (hashes of the text)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = rows.where(F.btrim("line", F.lit(SPACE_CHARS)) != "").select("doc_id", "row_key", "line_no", normal(F.col("line")).alias("text"))
    return lines.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def within_one(a: Column, b: Column) -> Column:
    """Whether one unit at most is replaced, added or left out between two arrays of units."""

    def common(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        first = F.array_position(same, False)
        return F.when(first > 0, first - 1).otherwise(F.size(same))

    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def _texts(docs: DataFrame, keyed: DataFrame, emit_all: bool) -> DataFrame:
    """h1, at, text of the lines that share a half with a different line (or of all that have units), each at its first place.

    Their places are found on narrow rows; only the documents of these places are read again.
    """
    keys = keyed.where("keys is not null")
    if not emit_all:
        each = keys.select("h1", F.explode("keys").alias("key"))
        shared = each.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key")
        keys = keys.join(small(written(each.join(shared, "key", "left_semi").select("h1").distinct(), "candidates")), "h1", "left_semi")
    places = small(written(keys.groupBy("h1", "h2").agg(F.min(_position()).alias("at")), "places"))
    owner = F.coalesce("doc_id", F.lit(_LAST_ID))
    owners = places.select(F.floor(F.col("at") / F.lit(_LINES).cast("decimal(11,0)")).cast("long").alias("owner")).distinct()
    some = docs.join(small(written(owners, "owners")), owner == F.col("owner"), "left_semi")
    found = _lines(some).withColumn("at", _position()).join(places, ["h1", "h2", "at"], "left_semi")
    return written(found.select("h1", "h2", "at", "text").distinct(), "texts")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _xors(hashes: Column) -> Column:
    """For each place the exclusive or of all hashes up to it, by doubling: n log n steps."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda step: step < F.size(hashes))
    return F.aggregate(steps, hashes, lambda done, step: F.transform(done, lambda x, i: x.bitwiseXOR(F.coalesce(F.get(done, i - step), F.lit(0).cast("long")))))


def _members() -> Column:
    """Keys of the whole line and of the line with each of its units left out: whole, without (array).

    A line's key is the exclusive or of one hash for each unit and its place. Left out, a unit moves those behind it one place ahead, so that
    each key follows from hashes at both places, and no variant is written out.
    """
    units = F.when(F.col("unit") == 1, F.split("text", " ")).otherwise(F.split("text", ""))
    here = lambda us, back: F.transform(us, lambda u, i: F.xxhash64(F.col("unit"), u, i - back))
    both = _let(units, lambda us: F.struct(here(us, 0).alias("own"), here(us, 1).alias("ahead")))

    def keys(h: Column) -> Column:
        behind = F.aggregate(h["ahead"], F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
        running = _xors(F.zip_with(h["own"], h["ahead"], lambda x, y: x.bitwiseXOR(y)))
        return _let(F.struct(running.alias("running"), behind.alias("behind")), lambda r: F.struct(
            F.element_at(r["running"], -1).bitwiseXOR(r["behind"]).alias("whole"),
            F.zip_with(r["running"], h["own"], lambda x, y: x.bitwiseXOR(y).bitwiseXOR(r["behind"])).alias("without"),
        ))

    return _let(both, keys)


def _near(docs: DataFrame, keyed: DataFrame, min_words: int, min_chars: int, emit_all: bool) -> DataFrame:
    """h1, h2 of the lines that have an earlier different line within one edit."""
    texts = _texts(docs, keyed, emit_all).withColumn("unit", _unit(min_words, min_chars))
    # a line is known by its place; without: the line without its i-th unit, complete: all of it. Keys of words and characters never meet.
    keyed = written(texts.where("unit > 0").select("at", _members().alias("keys")), "members")
    without = keyed.select("at", F.size("keys.without").alias("n"), F.posexplode("keys.without").alias("i", "key"))
    complete = small(written(keyed.select(F.col("at").alias("other"), F.col("keys.whole").alias("key")), "complete"))
    # one unit replaced: same length, same place left out; all such lines against the earliest
    best = without.groupBy("key", "i", "n").agg(F.min("at").alias("other"), F.max("at").alias("last")).where("other != last").select("key", "i", "n", "other")
    replaced = without.join(small(written(best, "best")), ["key", "i", "n"]).select("at", "other")
    # one unit more: each line that becomes a complete one, against it; and that one against the earliest of these
    longer = written(without.join(complete, "key").select("at", "other"), "longer")
    shorter = longer.groupBy("other").agg(F.min("at").alias("first")).select(F.col("other").alias("at"), F.col("first").alias("other"))
    pairs = replaced.union(longer).union(shorter).where("at > other").distinct()
    units = F.when(F.col("unit") == 1, F.split("text", " ")).otherwise(F.split("text", ""))
    own = texts.select("h1", "h2", "at", "unit", units.alias("units"))
    both = own.join(pairs, "at").join(texts.select(F.col("at").alias("other"), F.col("unit").alias("other_unit"), units.alias("other_units")), "other")
    return both.where((F.col("unit") == F.col("other_unit")) & within_one(F.col("units"), F.col("other_units"))).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, emit_all: bool = False) -> DataFrame:
    """doc_id, row_key, exact, near (line numbers to remove) of the rows of doc_id and text that lose lines."""
    lines = _lines(docs).withColumn("unit", _unit(min_words, min_chars))
    keyed = written(lines.select("doc_id", "row_key", "line_no", "h1", "h2", _halves().alias("keys")), "lines")
    near = _near(docs, keyed, min_words, min_chars, emit_all).select("h1", "h2", F.lit(True).alias("near"))
    firsts = keyed.groupBy("h1", "h2").agg(F.min(_position()).alias("first"), F.max(_position()).alias("last")).where("first != last").select("h1", "h2", "first")
    known = small(written(firsts.join(near, ["h1", "h2"], "full"), "known"))
    again = F.coalesce(_position() > F.col("first"), F.lit(False))
    gone = keyed.join(known, ["h1", "h2"]).select("doc_id", "row_key", "line_no", again.alias("again"), "near").where("again or near")
    return gone.groupBy("doc_id", "row_key").agg(F.collect_set(F.when(F.col("again"), F.col("line_no"))).alias("exact"), F.collect_set(F.when(~F.col("again"), F.col("line_no"))).alias("near"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines (with a word), n_exact, n_near, removed (sorted line numbers, from 0).

    A line goes if an equal line stands earlier (smaller id, then smaller line number), or if the first occurrence of
    another line within one edit does, whether or not that one stays. Lines without words always stay. Null
    texts are empty. Rows that share an id are one document: a line that is first at a place stays in all of them;
    rows without an id count as one document after all others. Extra columns are ignored. Options are those of removed_lines().
    """
    plain = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return _applied(plain, options).select("doc_id", "new_text", "n_lines", "n_exact", "n_near", "removed").withColumnRenamed("new_text", "text")


def _applied(docs: DataFrame, options: dict) -> DataFrame:
    """docs (with doc_id and text and perhaps more) with new_text, n_lines, n_exact, n_near, removed."""
    size = lambda c: F.size(c).cast("long")
    with tidy(docs.sparkSession):
        removed = removed_lines(docs.select("doc_id", "text"), **options)
        gone = removed.select(F.col("doc_id").alias("r_id"), "row_key", F.array_sort(F.concat("exact", "near")).alias("gone_"), size("exact").alias("exact_"), size("near").alias("near_"))
        gone = small(written(gone, "removed", last=True))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.xxhash64("text") == F.col("row_key")), "left")
    # the lines are a column of their own, as they are used inside functions of their places
    split = joined.select(*docs.columns, "gone_", "exact_", "near_", F.split("text", "\n", -1).alias("lines_"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), F.col("gone_"))
    new = F.when(F.col("gone_").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines_"), i)), "\n"))
    return split.select(
        *docs.columns,
        new.alias("new_text"),
        F.size(F.filter("lines_", lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")).cast("long").alias("n_lines"),
        F.coalesce("exact_", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("near_", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("gone_", F.array().cast("array<int>")).alias("removed"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents' own columns, the text without the removed lines.

    Documents that lose all their words to earlier ones are left out; those that had none before stay.
    """
    cols = [f"c{i}_" for i in range(len(docs.columns))]
    at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    plain = docs.toDF(*cols).withColumn("doc_id", F.col(cols[id_at]).cast("long")).withColumn("text", whole(cols[at]))
    out = _applied(plain, options).where("n_lines = 0 or n_lines > n_exact + n_near")
    new = F.when(F.size("removed") > 0, F.col("new_text")).otherwise(F.col(cols[at]))
    return out.select(*[(new if i == at else F.col(c)).alias(docs.columns[i]) for i, c in enumerate(cols)])
