"""Quality rules as a learned decision list: sequential covering over thresholds on text statistics.

Rules that reject are grown one by one on labelled statistics: a conjunction of thresholds gets the condition of the
best information gain until it covers no good document, is pruned from its end on rows held out from the
growing, and is taken only if the held-out rows bear it out. Rows it covers are set aside, and the next rule is grown.
The list becomes one ordered conditional Spark expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessavox.llm.common import pick, texts, whole

#: The symbols that count, and the white space that separates words.
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\v\f\r"
#: Most labelled documents that a list is learned from: those with the smallest hashes of their ids.
SAMPLE = 20_000
MIN_WORDS, REPEAT_SHARE = 50, 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct")
STATS_TYPE = "struct<" + ",".join(f"{s}:long" for s in STATS) + ">"


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers named by STATS; a null or empty text has zeros.

    n_lines and n_dup_lines count lines with a word; n_repeat_words counts the words that lie in
    a three-word window found twice or more; n_distinct counts different words.
    """
    if not text:
        return (0,) * len(STATS)
    words = text.encode().split()  # bytes split at ASCII white space only
    spaces = sum(map(text.count, SPACE))
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    w = np.fromiter([number(x, len(ids)) for x in words], np.int64, n)
    repeated = 0
    if n > 3:
        v = len(ids)
        if v < 2_000_000:
            key = (w[:-2] * v + w[1:-1]) * v + w[2:]
        else:
            _, pair = np.unique(w[:-1] * v + w[1:], return_inverse=True)
            key = pair[:-1] * v + w[2:]
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            cover[:-2] |= twice
            cover[1:-1] |= twice
            cover[2:] |= twice
            repeated = int(cover.sum())
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(text), len(lines), len(ids)


def stats_of(text: Column) -> Column:
    """A struct of the STATS of a text column, computed in Arrow batches."""

    @F.arrow_udf(STATS_TYPE)
    def stats(batch: pa.Array) -> pa.Array:
        rows = np.array([text_stats(x) for x in texts(batch)], np.int64).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATS))], list(STATS))

    return stats(text)


def _share(a: str, b: str) -> Column:
    """Shares are those of doubles, as in features()."""
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


#: Features that rules may test, as quotients of statistics.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f: stats[a].astype(float) / np.maximum(stats[b], 1).astype(float) for f, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = _share(*FEATURES[self.feature])
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(next(iter(x.values()))), bool)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, conditions: int, cuts: int) -> Rule:
    """One conjunction, by the gain p1 * (log(p1/(p1+n1)) - log(p/(p+n))) of each further condition."""
    rule: Rule = ()
    at = np.ones(len(y), bool)
    while len(rule) < conditions and at.any():
        p, n = int(y[at].sum()), int((~y[at]).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for f, values in x.items():
            v, good = values[at], y[at]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[:-1], method="lower")):
                high = v > t
                if not high.any():
                    continue
                t = (t + v[high].min()) / 2  # the middle of the gap, as far from either side's rows as it goes
                p_high, n_high = int(good[high].sum()), int((~good[high]).sum())
                for above, p1, n1 in ((True, p_high, n_high), (False, p - p_high, n - n_high)):
                    if p1 and (g := p1 * (math.log(p1 / (p1 + n1)) - math.log(p / (p + n)))) > gain:
                        best, gain = Condition(f, above, float(t)), g
        if best is None:
            break
        rule += (best,)
        at &= best.holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, conditions: int = 4, cuts: int = 64, precision: float = 0.97, support: int = 8) -> list[Rule]:
    """Ordered rules that reject.

    Rows are taken in turn for growing (two of three) and for pruning (the third), so their order should not
    depend on the labels. A rule needs the given precision over the held-out rows it covers, at least ``support``
    of them bad. Without labels of both kinds the list is empty.
    """
    held = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        sub = lambda mask: {f: v[mask] for f, v in x.items()}
        grow, prune = left & ~held, left & held
        if bad[grow].sum() < support or bad[prune].sum() < support or bad[grow].all():
            break
        rule = _grow(sub(grow), bad[grow], conditions, cuts)

        def worth(r: Rule, rows=sub(prune), y=bad[prune]) -> tuple[float, int]:
            c = covers(r, rows)
            p, n = int(y[c].sum()), int((~y[c]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())
        if not rule:
            break
        score, p = worth(rule)
        if p < support or (score + 1) / 2 < precision:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def reject_column(rules: list[Rule]) -> Column:
    """The list as an ordered conditional over columns named by STATS: true for rejected rows."""
    out = F.lit(False)
    for rule in reversed(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(True)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learn the list from at most ``sample`` labelled documents (label 0: reject, 1: keep).

    Null labels and ids are left out; an id with several labels takes the lowest.
    """
    marked = pick(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(marked), "doc_id")  # at most ``sample`` pairs of numbers
    got = rows.select("doc_id", "label", stats_of(F.col("text")).alias("s")).select("doc_id", "label", "s.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    if not got.num_rows:
        return []
    stats = {s: got.column(s).to_numpy() for s in STATS}
    usable = ~base_failed_rows(stats)  # the base rules take the rest anyway
    return learn({f: v[usable] for f, v in features(stats).items()}, got.column("label").to_numpy()[usable] == 0)


def base_failed_rows(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_SHARE * stats["n_words"])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """All columns of the documents under names c0_, c1_, ..., then STATS, base_failed and kept. Nothing moves."""
    plain = docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index(text_col)}_")
    out = plain.withColumn("s_", stats_of(text)).select(*plain.columns, "s_.*")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~reject_column(rules))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, statistics, base_failed and kept of every row.

    Null and empty texts have no words and so fail the base rules. Repeated rows get equal
    verdicts. Without usable labels only the base rules judge. Extra columns are ignored.
    """
    rules = fit(docs, labels, id_col, text_col, label_col, sample)
    return judged(pick(docs, doc_id=id_col, text=text_col), rules).select(F.col("c0_").cast("long").alias("doc_id"), *STATS, "base_failed", "kept")


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The documents that are kept, with their own columns."""
    out = judged(docs, fit(docs, labels, id_col, text_col, label_col, sample), text_col).where("kept")
    return out.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)])


def describe(rules: list[Rule]) -> Iterator[str]:
    """The list in words, a line for each rule."""
    for rule in rules:
        yield "reject if " + " and ".join(map(str, rule))
    yield "else keep"
