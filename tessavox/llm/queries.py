"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavox.llm.archives import archived
from tessavox.llm.common import table
from tessavox.llm.conversation_repair import damaged, repaired
from tessavox.llm.decontaminate import decontamination
from tessavox.llm.importance import resampled
from tessavox.llm.jaccard import near_duplicates as shingle_duplicates
from tessavox.llm.line_dedup import line_dedup
from tessavox.llm.pieces import encode_decode
from tessavox.llm.quality_rules import quality
from tessavox.llm.quotes import linked_conversations
from tessavox.llm.sanitise import listed, sanitisation
from tessavox.llm.sentence_spans import substring_dedup
from tessavox.llm.simhash import near_duplicates
from tessavox.llm.token_files import tokenized, with_crc32

#: Folder of the public vocabularies' files; None takes that of the installed package.
TOKENIZERS: str | None = os.environ.get("TESSAVOX_TOKENIZERS")


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc32(tokenized(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ids=False)


def op4_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitisation(table(spark, sf_dir, "documents"))

    def count(kind: int, name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")

    counts = [count(k, name) for k, name in enumerate(("email", "ip", "card", "phone"))]
    spans = listed(F.array_sort(F.concat("base", "terms")))
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("terms").cast("long").alias("n_terms"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked_conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "parent", "root", "depth", "position", "n_quotes", "max_level", F.sha2("formatted", 256).alias("formatted_sha256"))


def quoted(messages: DataFrame) -> DataFrame:
    """The messages as they would look in mail: each but the first quotes an earlier one, and what that one quotes at level two."""

    def behind(marks: str, text: str) -> Column:
        return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(marks), x)), "\n")

    of = lambda turn: F.when(F.col(turn) > 0, (F.col("conv_id") * 7 + F.col(turn) * F.col(turn) * 3) % F.col(turn))
    plain = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    first = plain.select("conv_id", F.col("turn").alias("t1"), F.col("role").alias("r1"), F.col("text").alias("x1"))
    second = plain.select("conv_id", F.col("turn").alias("t2"), F.col("text").alias("x2"))
    both = plain.withColumn("t1", of("turn")).join(first, ["conv_id", "t1"], "left").withColumn("t2", of("t1")).join(second, ["conv_id", "t2"], "left")
    deep = F.coalesce(F.concat(behind(">> ", "x2"), F.lit("\n")), F.lit(""))
    mail = F.concat(F.lit("On day 1, the "), "r1", F.lit(" wrote:\n\n"), deep, behind("> ", "x1"), F.lit("\n\n"), F.col("text"))
    return both.select("conv_id", "turn", "role", F.coalesce(mail, F.col("text")).alias("text"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with quotations put in, and taken out again by their links."""
    out = linked_conversations(quoted(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "parent", "root", "depth", "position", "max_level", F.sha2("text", 256).alias("text_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.array_join("removed", ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.array_join("removed", ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_duplicates(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_TREES = """
t AS (SELECT m.conv_id, m.turn, l.parent, m.turn AS root, 0 AS depth, [m.turn] AS path FROM m LEFT JOIN l USING (conv_id, turn) WHERE l.parent IS NULL
  UNION ALL SELECT l.conv_id, l.turn, l.parent, t.root, t.depth + 1, list_append(t.path, l.turn) FROM l JOIN t ON t.conv_id = l.conv_id AND t.turn = l.parent)
"""
#: What is there to quote: whole messages, paragraphs, lines.
_PASSAGES = rf"""
p AS (SELECT conv_id, turn, {_NORM.format("text")} AS w FROM m
  UNION SELECT conv_id, turn, {_NORM.format("x")} FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x FROM m)
  UNION SELECT conv_id, turn, {_NORM.format("x")} FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\n[ \t\r]*\n')) AS x FROM m))
"""
QUOTED = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), {_PASSAGES},
q AS (SELECT conv_id, turn, (conv_id * 7 + turn * turn * 3) % turn AS other FROM m WHERE turn > 0),
l AS (SELECT q.conv_id, q.turn, min(p.turn) AS parent
  FROM q JOIN m o ON o.conv_id = q.conv_id AND o.turn = q.other JOIN p ON p.conv_id = q.conv_id AND p.turn < q.turn AND p.w = {_NORM.format("o.text")}
  WHERE p.w <> '' GROUP BY q.conv_id, q.turn), {_TREES}
SELECT t.conv_id, t.turn, t.parent, t.root, t.depth, row_number() OVER (PARTITION BY t.conv_id, t.root ORDER BY t.path) - 1 AS position,
  CASE WHEN q.other IS NULL THEN 0 WHEN q.other > 0 THEN 2 ELSE 1 END AS max_level, sha256(m.text) AS text_sha256
FROM t JOIN m USING (conv_id, turn) LEFT JOIN q USING (conv_id, turn)
"""
#: Lines with their levels, runs of one level, each whole and by line; the level decides before the size. Announcing lines right above
#: (blank ones between) go with the quotation.
OP5 = rf"""
WITH RECURSIVE r AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
x AS (SELECT conv_id, turn, i, ls[i] AS line, regexp_extract(ls[i], '^[ \t]*((?:>[ \t]*)+)', 1) AS marks FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM r)),
y AS (SELECT *, len(marks) - len(replace(marks, '>', '')) AS level FROM x),
z AS (SELECT *, regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', '') AS bare, lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) IS DISTINCT FROM level AS starts,
  min(CASE WHEN level > 0 THEN i END) OVER w AS next_quote, min(CASE WHEN level = 0 AND trim(line, ' \t\r') <> '' THEN i END) OVER w AS next_own
  FROM y WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run,
  level = 0 AND next_quote IS NOT NULL AND (next_own IS NULL OR next_own > next_quote)
    AND regexp_matches(line, '(?i)^\s*(?:(?:on|am|le|el)\b.{{1,200}}\b|\S{{1,60}}(?: \S{{1,60}}){{0,5}} )(?:wrote|schrieb|écrit|escribió)\s*:\s*$') AS announces FROM z),
a AS (SELECT *, max(CASE WHEN announces THEN i END) OVER (PARTITION BY conv_id, turn, run ORDER BY i) AS from_here FROM g),
own AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) AS text FROM a WHERE level = 0 AND from_here IS NULL GROUP BY conv_id, turn),
m AS (SELECT r.conv_id, r.turn, r.role, regexp_replace(regexp_replace(coalesce(own.text, ''), '^(?:[ \t\r\f\v]*\n)+', ''), '(?:\n[ \t\r\f\v]*)+$', '') AS text FROM r LEFT JOIN own USING (conv_id, turn)), {_PASSAGES},
c AS (SELECT conv_id, turn, 2 * level AS rank, {_NORM.format("string_agg(bare, ' ' ORDER BY i)")} AS w FROM g WHERE level > 0 GROUP BY conv_id, turn, level, run
  UNION SELECT conv_id, turn, 2 * level + 1, {_NORM.format("bare")} FROM g WHERE level > 0),
l AS (SELECT conv_id, turn, arg_min(parent, (rank, parent)) AS parent FROM (SELECT c.conv_id, c.turn, c.rank, min(p.turn) AS parent FROM c JOIN p ON p.conv_id = c.conv_id AND p.w = c.w
  WHERE c.w <> '' GROUP BY c.conv_id, c.turn, c.rank, c.w) WHERE parent < turn GROUP BY conv_id, turn), {_TREES},
n AS (SELECT conv_id, turn, count(DISTINCT run) FILTER (level > 0) AS n_quotes, max(level) AS max_level FROM g GROUP BY conv_id, turn)
SELECT t.conv_id, t.turn, m.role, t.parent, t.root, t.depth, row_number() OVER (PARTITION BY t.conv_id, t.root ORDER BY t.path) - 1 AS position,
  n.n_quotes, n.max_level, sha256('<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || m.text) AS formatted_sha256
FROM t JOIN m USING (conv_id, turn) JOIN n USING (conv_id, turn)
"""

OP6 = r"""
WITH r AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, lower(trim(regexp_replace(ls[i], '[\t\x0B\f\r ]+', ' ', 'g'))) AS t
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM r)),
w AS (SELECT *, string_split(t, ' ') AS ws FROM l WHERE t <> ''),
f AS (SELECT t, min((doc_id, line_no)) AS pos, any_value(ws) AS ws, len(any_value(ws)) AS n FROM w GROUP BY t),
u AS (SELECT t, pos, CASE WHEN n >= 10 THEN 'w' WHEN length(t) >= 20 THEN 'c' END AS unit, CASE WHEN n >= 10 THEN ws ELSE [substring(t, i, 1) for i in range(1, length(t) + 1)] END AS us FROM f),
v AS (SELECT t, pos, unit, len(us) AS n, i, CASE unit WHEN 'w' THEN array_to_string(list_concat(us[1:i - 1], us[i + 1:]), ' ') ELSE substring(t, 1, i - 1) || substring(t, i + 1) END AS k
  FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM u WHERE unit IS NOT NULL)),
near AS (
  SELECT a.t FROM v a JOIN v b ON a.k = b.k AND a.i = b.i AND a.n = b.n AND a.unit = b.unit AND a.pos > b.pos
  UNION SELECT a.t FROM v a JOIN u b ON a.k = b.t AND a.unit = b.unit AND a.pos > b.pos
  UNION SELECT b.t FROM v a JOIN u b ON a.k = b.t AND a.unit = b.unit AND b.pos > a.pos),
d AS (SELECT w.doc_id, w.line_no, (w.doc_id, w.line_no) > f.pos AS again, w.t IN (SELECT t FROM near) AS near
  FROM w JOIN f USING (t)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_exact, count(*) FILTER (near AND NOT again) AS n_near,
    list(line_no ORDER BY line_no) FILTER (again OR near) AS gone FROM d GROUP BY doc_id)
SELECT r.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
  coalesce(array_to_string(gone, ','), '') AS removed,
  sha256(array_to_string([ls[i + 1] for i in range(len(ls)) if NOT coalesce(list_contains(gone, i), false)], chr(10))) AS text_sha256
FROM r LEFT JOIN g USING (doc_id)
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""

#: Rows after damage in order; state by state the least cost and audit over the rows, deletions before insertions.
OP11 = r"""
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], [CAST(ord(key[i]) AS BIGINT) for i in range(1, length(key) + 1)]), lambda c, b:
    list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 20 AS fault FROM k),
dam AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
  unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM dam),
g AS (SELECT *, CASE WHEN regexp_full_match(text, '[ 	-
]*') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[^ 	-
.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS m FROM g GROUP BY conv_id),
pairs(s, t, k) AS (VALUES ('', 's', 0), ('', 'u', 0), ('', 'a', 1), ('s', 'u', 0), ('s', 'a', 1), ('u', 'a', 0), ('u', 'u', 1), ('a', 'u', 0), ('a', 'a', 1)),
ways AS (SELECT g.conv_id, g.i, p.s, p.t, 5 * p.k + CASE WHEN g.role[1] = p.t THEN 0 ELSE 1 END + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS price,
    repeat('I', p.k) || CASE WHEN g.role[1] = p.t THEN 'K' ELSE 'R' END AS letters
  FROM g, pairs p WHERE g.fault NOT IN ('blank', 'duplicate') AND (g.role[1] = p.t OR p.t <> 's')
  UNION ALL SELECT conv_id, i, s, s, 2, 'D' FROM g, (VALUES (''), ('s'), ('u'), ('a')) AS v(s)),
dp AS (SELECT conv_id, 0::BIGINT AS i, '' AS s, 0::BIGINT AS cost, '' AS audit FROM n
  UNION ALL SELECT conv_id, i, s, cost, audit FROM (SELECT w.conv_id, w.i, w.t AS s, dp.cost + w.price AS cost, dp.audit || w.letters AS audit,
    row_number() OVER (PARTITION BY w.conv_id, w.t ORDER BY dp.cost + w.price, dp.audit || w.letters) AS k
    FROM dp JOIN ways w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.i = dp.i + 1 AND w.s = dp.s) WHERE k = 1),
fin AS (SELECT conv_id, cost, audit FROM (SELECT dp.conv_id, dp.cost + 5 * e.k AS cost, dp.audit || repeat('I', e.k) AS audit,
    row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 5 * e.k, dp.audit || repeat('I', e.k)) AS best
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.m = dp.i JOIN (VALUES ('', 0), ('s', 2), ('u', 1), ('a', 0)) AS e(s, k) ON e.s = dp.s) WHERE best = 1),
ed AS (SELECT conv_id, audit, j, audit[j] AS e, len(replace(audit[1:j], 'I', '')) AS i, len(replace(audit[1:j], 'D', '')) AS line FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM fin)),
ls AS (SELECT ed.*, g.role, g.text, max(CASE WHEN ed.e <> 'D' AND ed.line = 1 AND ed.e = 'K' AND g.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY ed.conv_id) AS has_s
  FROM ed LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ed.conv_id AND g.i = ed.i),
rep AS (SELECT conv_id, string_agg(CASE e WHEN 'K' THEN role ELSE CASE (line - has_s) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
  FROM ls WHERE e <> 'D' GROUP BY conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(fin.cost, 0) AS cost, coalesce(fin.audit, '') AS audit, sha256(coalesce(rep.t, '')) AS repaired_sha256
FROM o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Sets by list of different shingles, all pairs that share one, then the closure of the links over the texts' sets.
OP12 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) END AS t FROM d),
n AS (SELECT t, min(doc_id) AS least, row_number() OVER (ORDER BY min(doc_id), t) AS k, len(t) AS n FROM s WHERE len(t) > 0 GROUP BY t),
x AS (SELECT k, n, unnest(t) AS g FROM n),
l AS (SELECT a.k AS p, b.k AS q FROM x a JOIN x b ON a.g = b.g AND a.k < b.k GROUP BY a.k, a.n, b.k, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
c AS (SELECT k AS p, k AS root FROM n UNION SELECT e.q, c.root FROM c JOIN e ON e.p = c.p WHERE c.root < e.q),
m AS (SELECT p, min(root) AS root FROM c GROUP BY p)
SELECT s.doc_id, len(s.t) AS n_shingles, CASE WHEN len(s.t) = 0 THEN s.doc_id ELSE o.least END AS component_id
FROM s LEFT JOIN n ON n.t = s.t LEFT JOIN m ON m.p = n.k LEFT JOIN n o ON o.k = m.root
"""
#: Buckets of the different features by a table of CRC-32 steps, eight shifts for each of 256 bytes.
OP13 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
fd AS (SELECT doc_id, len(w) AS n_words, list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS f FROM d),
fb AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM b),
u AS (SELECT row_number() OVER () AS r, doc_id, n_words, f FROM fd),
x AS (SELECT r, unnest(f) AS f FROM u),
k AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], [CAST(CAST('0x' || substring(hex(encode(f)), 2 * i - 1, 2) AS INTEGER) AS BIGINT) for i in range(1, strlen(f) + 1)]), lambda c, y:
    list_reduce(list_concat([xor(c, y)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM x UNION SELECT f FROM fb)),
s AS (SELECT bucket, count(*) AS s FROM x JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM fb JOIN k USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT u.*, coalesce(w.n_features, 0) AS n_features, coalesce(w.weight, 0) AS weight,
  floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM u LEFT JOIN w USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM h)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM o
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_token_files, op3_piece_codec, op4_sanitisation, op5_quotation_links, op6_line_dedup, op7_quality_rules, op8_archives, op9_sentence_spans, op10_simhash, op11_conversation_repair, op12_jaccard, op13_resampling, quoted_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op5_quotation_links": OP5, "quoted_conversations": QUOTED, "op6_line_dedup": OP6, "op8_archives": OP8, "op11_conversation_repair": OP11, "op12_jaccard": OP12, "op13_resampling": OP13}
