"""Information-theoretic sanitisation, in DataFrame and SQL functions only.

Base entities (mail addresses, IP addresses, card and phone numbers) are found by patterns. Then the corpus tells which
terms give them away, or give away the group they belong to (mail domain, network, card issuer, number block): a term t
discloses the share PMI(e; t) / IC(e) of the information of an entity or group e, where
PMI(e; t) = log(N n(e,t) / (n(e) n(t))), IC(e) = log(N / n(e)), N is the number of documents, and the n are numbers of
documents that hold e, t, or t within CONTEXT characters of e. Terms whose share reaches the threshold in enough different texts
are spans of kind ``term`` wherever they stand in a document that holds e. In the sanitised text base entities become
their kind's name, and such terms are generalised (numbers, names) or removed.

What a text costs is in proportion to its length, however many entities it holds: entities meet only the terms around them,
and folds over matches are cut in chunks, so no array grows by one element at a time beyond CHUNK.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import pick, small, tidy, whole, written

#: Base kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns. Possessive groups and the look-arounds only spare the engine hopeless attempts (a run of characters in
#: which one start failed fails for its later starts too; a run of digits is a card's in whole or not at all).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Fixed value: words that can be terms.
TERM = r"[\p{L}\p{N}](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}])?"
#: Characters on each side of an entity in which terms are counted with it; share of its information from which a term
#: discloses; least different texts that hold both, for an entity and for a group of them; least length of a term.
CONTEXT, SHARE, SUPPORT, GROUP_SUPPORT, LENGTH = 600, 0.9, 2, 3, 3
#: Matches in a chunk of a fold; code points in a block of a text.
CHUNK, BLOCK = 64, 4096

_SPAN = "struct<start:int,kind:int,stop:int,value:string>"
_NONE = f"array<{_SPAN}>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Arrays that step(at, item) -> (next at, array to add) makes of the items in turn, put together.

    Each chunk is folded by itself, from where the one before ended.
    """
    empty = F.array().cast(kind)

    def inner(at: Column, chunk: Column) -> Column:
        def add(acc: Column, item: Column) -> Column:
            now, more = step(acc["at"], item)
            return F.struct(now.alias("at"), F.concat(acc["out"], more).alias("out"))

        return F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("out")), add)

    def fold(every: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(every) - 1) / CHUNK).cast("int")), lambda i: F.slice(every, i * CHUNK + 1, CHUNK))
        begin = F.array(F.struct(start.alias("at"), empty.alias("out")))
        done = F.aggregate(chunks, begin, lambda acc, chunk: F.concat(acc, F.array(inner(F.element_at(acc, -1)["at"], chunk))))
        return F.when(F.size(every) > 0, F.flatten(F.transform(done, lambda d: d["out"]))).otherwise(empty)

    return _let(items, fold)


def _found(text: Column, pattern: str, kind: int, fits: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """The matches that fit, with their places: each match with the piece before it, lengths added up in turn."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda before, value: F.struct(before.alias("before"), value.alias("value")))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.char_length(pair["before"])
        stop = start + F.coalesce(F.char_length(pair["value"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), pair["value"].alias("value"))
        return stop, F.when(pair["value"].isNotNull() & fits(pair["value"]), F.array(span)).otherwise(F.array().cast(_NONE))

    return _folded(pairs, F.lit(0), step, _NONE)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Entities of all base kinds, by start and then kind; places in code points, stop exclusive."""
    low = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    is_ip = lambda v: F.forall(F.split(v, r"\."), lambda p: (F.char_length(low(p)) <= 3) & (F.lpad(low(p), 3, "0") <= "255"))
    email = F.when(F.contains(text, F.lit("@")), _found(text, PATTERNS["email"], 0))
    ip = F.when(F.contains(text, F.lit(".")), _found(text, PATTERNS["ip"], 1, is_ip))
    card = _found(text, PATTERNS["card"], 2, lambda v: _luhn(_digits(v)))
    phone = F.when(F.contains(text, F.lit("+")), _found(text, PATTERNS["phone"], 3, lambda v: F.char_length(_digits(v)).between(10, 15)))
    none = F.array().cast(_NONE)
    return F.array_sort(F.concat(F.coalesce(email, none), F.coalesce(ip, none), card, F.coalesce(phone, none)))


def _blocks(text: Column) -> Column:
    """The text in pieces of BLOCK code points, so that a place is found without walking there from the begin."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, start: Column, stop: Column) -> Column:
    """Code points start..stop of the text in blocks."""
    first, last = (start / BLOCK).cast("int"), ((stop - 1) / BLOCK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(stop > start, F.substring(joined, start % BLOCK + 1, stop - start)).otherwise(F.lit(""))


def _replaced(text: Column, spans: Column, token: Callable[[Column, Column], Column]) -> Column:
    """The text with token(original, span) for each span; a span that overlaps an earlier kept one is left out."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        free = s["start"] >= at
        return F.when(free, s["stop"]).otherwise(at), F.when(free, F.array(F.struct(at.alias("after"), s.alias("s")))).otherwise(F.array().cast(kind))

    kind = f"array<struct<after:int,s:{_SPAN}>>"

    def of(both: Column) -> Column:
        blocks, kept = both["blocks"], both["kept"]
        parts = F.transform(kept, lambda k: F.concat(_piece(blocks, k["after"], k["s"]["start"]), token(_piece(blocks, k["s"]["start"], k["s"]["stop"]), k["s"])))
        rest = _piece(blocks, F.element_at(kept, -1)["s"]["stop"], both["size"])
        return F.concat(F.array_join(parts, ""), rest)

    both = F.struct(_blocks(text).alias("blocks"), _folded(spans, F.lit(0), step, kind).alias("kept"), F.char_length(text).alias("size"))
    return F.when(F.size(spans) > 0, _let(both, of)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in the place of its spans."""
    return _replaced(text, spans, lambda original, s: F.repeat(F.lit(" "), F.char_length(original)))


def _keys(s: Column) -> Column:
    """key and support of an entity, the same for every spelling, and of the group it belongs to."""
    digits = _digits(s["value"])
    value = F.when(s["kind"] >= 2, digits).otherwise(F.lower(s["value"]))
    group = (
        F.when(s["kind"] == 0, F.substring_index(F.lower(s["value"]), "@", -1))
        .when(s["kind"] == 1, F.substring_index(s["value"], ".", 3))
        .when(s["kind"] == 2, F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, F.lit(1), F.char_length(digits) - 4))
    )
    one = lambda level, v: F.struct(F.xxhash64(F.lit(level), s["kind"], v).alias("key"), F.lit(level).alias("level"))
    return F.array(one(0, value), one(1, group))


def _around(text: Column, base: Column) -> Column:
    """For each entity its keys and the hashes of the different terms around it, entities themselves left out."""

    def of(both: Column) -> Column:
        blocks, size = both["blocks"], both["size"]

        def one(s: Column) -> Column:
            left, right = F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["stop"] + CONTEXT, size)
            # a term that the edge may have cut is left out
            before = F.when(left > 0, F.regexp_replace(_piece(blocks, left, s["start"]), r"^[\p{L}\p{N}_'-]+", "")).otherwise(_piece(blocks, left, s["start"]))
            behind = F.when(right < size, F.regexp_replace(_piece(blocks, s["stop"], right), r"[\p{L}\p{N}_'-]+$", "")).otherwise(_piece(blocks, s["stop"], right))
            terms = F.filter(F.regexp_extract_all(F.lower(F.concat(before, F.lit(" "), behind)), F.lit(TERM), F.lit(0)), lambda t: F.char_length(t) >= LENGTH)
            return F.struct(_keys(s).alias("keys"), F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t))).alias("terms"))

        return F.transform(base, one)

    return _let(F.struct(_blocks(blanked(text, base)).alias("blocks"), F.char_length(text).alias("size")), of)


def _words(text: Column) -> Column:
    """Hashes of the different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(t)))


def disclosing(docs: DataFrame, marked: DataFrame, share: float = SHARE, support: int = SUPPORT, group_support: int = GROUP_SUPPORT) -> tuple[DataFrame, DataFrame]:
    """key, term (hashes) of the pairs whose term discloses at least ``share`` of the information; and row_key, key.

    Copies of a text count as documents, but as one text for the support. Pairs are counted where both stand together, the words
    of the whole corpus once, each as a hash that is added up before it moves.
    """
    n = float(docs.count())
    entities = marked.select("row_key", F.explode(_around(F.col("text"), F.col("base"))).alias("e")).select("row_key", F.explode("e.keys").alias("k"), "e.terms")
    near = written(entities.select("row_key", "k.key", "k.level", F.explode("terms").alias("term")).distinct(), "near")
    holders = written(entities.select("row_key", "k.key").distinct(), "holders")
    copies = small(written(marked.groupBy("row_key").agg(F.count("*").alias("m")), "copies"))
    n_et = near.join(copies, "row_key").groupBy("key", "level", "term").agg(F.sum("m").alias("n_et"), F.count("*").alias("texts"))
    pairs = written(n_et.where(F.col("texts") >= F.when(F.col("level") == 0, support).otherwise(group_support)).select("key", "term", "n_et"), "pairs")
    n_e = holders.join(copies, "row_key").groupBy("key").agg(F.sum("m").alias("n_e"))
    n_t = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    # an inner join, so that the words are added up before they meet the candidates
    held = written(n_t.join(written(pairs.select("term").distinct(), "terms"), "term"), "held")
    pmi = F.log(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    told = pairs.join(n_e, "key").join(held, "term").where((F.col("n_e") < n) & (pmi >= share * F.log(F.lit(n) / F.col("n_e"))))
    return told.select("key", "term"), holders


def _spans(marked: DataFrame, told: DataFrame, holders: DataFrame) -> DataFrame:
    """row_key, terms: spans of the disclosing terms of each text that holds what they disclose.

    Words of the texts are looked up among the terms first and then meet their own text's entities, so there are no rows for
    terms that a text doesn't have, however many texts share an entity or a group.
    """
    told = written(told, "told")
    texts = holders.join(small(written(told.select("key").distinct(), "keys")), "key", "left_semi").select("row_key").distinct()
    some = marked.join(small(written(texts, "texts")), "row_key", "left_semi")
    places = some.select("row_key", F.explode(_found(blanked(F.col("text"), F.col("base")), TERM, 4)).alias("t"))
    hashed = places.select("row_key", F.xxhash64(F.lower("t.value")).alias("term"), F.struct("t.start", "t.kind", "t.stop", F.lower("t.value").alias("value")).alias("t"))
    found = written(hashed.join(small(written(told.select("term").distinct(), "terms")), "term", "left_semi").distinct(), "places")
    both = found.select("row_key", "term").distinct().join(holders, "row_key").join(small(told), ["key", "term"], "left_semi")
    wanted = written(both.select("row_key", "term").distinct(), "wanted")
    return found.join(small(wanted), ["row_key", "term"], "left_semi").groupBy("row_key").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def sanitisation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, support: int = SUPPORT, group_support: int = GROUP_SUPPORT) -> DataFrame:
    """doc_id, text, base, terms (arrays of spans: start, kind, stop, value; by start and kind), sanitised of every row.

    Null and empty texts have no spans. Rows with equal id and text are one document and get equal
    results; rows without an id take part like others. An empty table gives no row. Extra columns are ignored.
    """
    plain = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    with tidy(docs.sparkSession):
        found = plain.select("doc_id", "text", F.xxhash64("text").alias("row_key"), base_spans(F.col("text")).alias("base"))
        marked = written(found.where(F.size("base") > 0), "marked")
        terms = _spans(marked, *disclosing(plain, marked, share, support, group_support)).withColumnRenamed("row_key", "t_key")
        every = marked.select("doc_id", "row_key", "base").dropDuplicates(["doc_id", "row_key"]).join(terms, F.col("row_key") == F.col("t_key"), "left")
        spans = written(every.select(F.col("doc_id").alias("r_id"), F.col("row_key").alias("r_key"), "base", "terms"), "spans", last=True)
    joined = plain.join(small(spans), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.xxhash64("text") == F.col("r_key")), "left")
    none = F.array().cast(_NONE)
    out = joined.select("doc_id", "text", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))
    return out.withColumn("sanitised", sanitised_text(F.col("text"), F.array_sort(F.concat("base", "terms"))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def sanitised_text(text: Column, spans: Column) -> Column:
    """The text with base entities replaced by their kind and terms generalised or removed; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])

    def token(original: Column, s: Column) -> Column:
        general = F.when(original.rlike(r"\p{N}"), "[NUMBER]").when(original.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        return F.when(s["kind"] < 4, F.get(names, s["kind"])).otherwise(general)

    return _replaced(text, spans, token)
