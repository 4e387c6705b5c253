"""Session settings that fit the operators; everything can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",  # ranges of z reach the files
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call site for each column: plans of many columns are built faster
}


def session(name: str = "tessavox", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; keys of ``more`` have double underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
