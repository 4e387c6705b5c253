"""Training histories in long form: epoch, metric, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_means(batches: DataFrame, *groups: str) -> DataFrame:
    """Sum of batch values over number of batches; batches count alike, whatever their size."""
    return batches.groupBy(*groups).agg((F.sum("value") / F.count("value")).alias("value"))


def carried(history: DataFrame, epochs: DataFrame, metric: str = "metric", epoch: str = "epoch") -> DataFrame:
    """Every epoch for every metric; missing values repeat the last known one (null before the first)."""
    every = epochs.select(epoch).distinct().crossJoin(F.broadcast(history.select(metric).distinct()))  # metrics are a handful of names
    last = F.last("value", ignorenulls=True).over(Window.partitionBy(metric).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0))
    return every.join(history.select(epoch, metric, "value"), [epoch, metric], "left").select(epoch, metric, last.alias("value"))


def best_so_far(history: DataFrame, metric: str = "metric", epoch: str = "epoch") -> DataFrame:
    """epoch, metric, value, best, improved: running minimum, as the checkpoint of the best loss follows it."""
    before = F.min("value").over(Window.partitionBy(metric).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    return history.select(epoch, metric, "value", F.least("value", F.coalesce(before, "value")).alias("best"), (before.isNull() | (F.col("value") < before)).alias("improved"))


def every(history: DataFrame, k: int, epoch: str = "epoch") -> DataFrame:
    return history.where(F.col(epoch) % k == 0)


def best_slice(masks: DataFrame, mask: str = "gt", *groups: str) -> DataFrame:
    """groups, z, total: the slice with most foreground, the first of equals; the middle one where there is none."""
    sums = masks.groupBy(*groups, "z").agg(F.sum(mask).alias("total"))
    best = sums.groupBy(*groups).agg(F.max_by(F.struct("z", "total"), F.struct("total", -F.col("z"))).alias("b"), (F.max("z") + 1).alias("depth"))
    return best.select(*groups, F.when(F.col("b.total") > 0, F.col("b.z")).otherwise(F.expr("depth DIV 2")).alias("z"), F.col("b.total").alias("total"))


def profile(log: DataFrame, kind: str, seconds: str, flops: str) -> DataFrame:
    """kind, n, seconds, flops, share: a table of modules by type, with each one's share of the time in percent."""
    rows = log.groupBy(kind).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"), F.sum(flops).alias("flops"))
    return rows.withColumn("share", 100 * F.col("seconds") / F.sum("seconds").over(Window.partitionBy()))  # a row for each type
