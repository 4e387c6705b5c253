"""Five stages that make a training corpus of the table documents: each stage's result is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessavox.llm import decontaminate, line_dedup, pieces, quality_rules, simhash
from tessavox.llm.common import drop, table, tidy, written
from tessavox.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the list learned from the labels keep."""
    return quality_rules.filtered(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; n_chars follows the new text."""
    out = line_dedup.deduplicated(docs)
    return out.selectExpr("doc_id", "text", "lang", "source", "CAST(char_length(text) AS BIGINT) AS n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's whole text, with digests of the ids and of the decoded text."""
    return pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL can't express the learned list, the fingerprints or the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written, then what it was made from is removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with tidy(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", last=True)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
