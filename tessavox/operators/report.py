"""Evaluation reports: pooled pixel counts and mean slice metrics by pair, then summaries by model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessavox.operators import metrics, objects

_COUNTS = ("tp", "fp", "fn", "tn")
SUMMARY = ("accuracy", "precision", "recall", "f1", "iou", "dice", "mcc", "hausdorff", "cldice", "obj_f1", "pr_auc")
#: Columns of the detailed report behind those of the pair, and of the summary behind the model.
DETAILED_COLUMNS = ("files_evaluated", "pixels_total", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "mcc", "hausdorff", "cldice", "obj_f1", "pr_auc", "gt_count", "pr_count")
SUMMARY_COLUMNS = ("accuracy_mean", "accuracy_std", "precision_mean", "precision_std", "recall_mean", "recall_std", "f1_mean", "f1_std", "mcc_mean", "hausdorff_mean", "cldice_mean", "obj_f1_mean", "pr_auc_mean")


def detailed(rows: DataFrame, *pair: str, slice_col: str = "z", hd_percentile: float = 95.0, min_iou: float = 0.5, min_size: int = 0, connectivity: int = 2) -> DataFrame:
    """pair, files_evaluated, pixels_total, tp .. tn pooled with their scores; mcc, hausdorff, cldice, obj_f1 and pr_auc are
    means over slices, gt_count and pr_count sums of their objects.

    Hausdorff leaves out slices with an empty mask, pr_auc those at 0; 0 where none is left.
    """
    by_slice = [*pair, slice_col]
    each = metrics.scores(metrics.confusion(rows, *by_slice)).select(*by_slice, *_COUNTS, "mcc")
    found = objects.object_metrics(rows, *by_slice, min_iou=min_iou, min_size=min_size, connectivity=connectivity, hd_percentile=hd_percentile)
    auc = metrics.average_precision(rows, *by_slice)
    per = each.join(found, by_slice, "left").join(auc, by_slice, "left")
    mean = per.groupBy(*pair).agg(
        *[F.sum(n).alias(n) for n in _COUNTS],
        F.count("*").alias("files_evaluated"),
        F.avg("mcc").alias("mean_mcc"),
        *[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in ("hausdorff", "cldice", "obj_f1")],
        F.coalesce(F.avg(F.when(F.col("pr_auc") > 0, F.col("pr_auc"))), F.lit(0.0)).alias("pr_auc"),
        F.sum("gt_count").alias("gt_count"),
        F.sum("pr_count").alias("pr_count"),
    )
    pooled = metrics.scores(mean.withColumn("pixels_total", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).drop("mcc")
    return pooled.withColumnRenamed("mean_mcc", "mcc")


def summary(details: DataFrame, model: str = "model", names: tuple[str, ...] = SUMMARY) -> DataFrame:
    """model, n and each metric's mean and population deviation."""
    aggs = [f(n).alias(f"{n}_{s}") for n in names if n in details.columns for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return details.groupBy(model).agg(F.count("*").alias("n"), *aggs)


def write(details: DataFrame, summary_: DataFrame, path: str, *pair: str, model: str = "model") -> None:
    """Both tables as CSV under the reports' headers (pair and model lead); a row for each pair and model, so one file each."""
    for name, df in (("detailed", details.select(*pair, *DETAILED_COLUMNS)), ("summary", summary_.select(model, *SUMMARY_COLUMNS))):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
