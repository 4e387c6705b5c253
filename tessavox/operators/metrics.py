"""Segmentation metrics over rows of truth (gt), prediction (pr) and score, each as aggregates over any groups."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessavox.functions import losses
from tessavox.operators.distance import hausdorff


def counts(gt: str = "gt", pr: str = "pr") -> list[Column]:
    g, p = F.col(gt) == 1, F.col(pr) == 1
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")]


def compared(truth: DataFrame, predicted: DataFrame, *pair: str) -> DataFrame:
    """pair, z, y, x, gt, pr, score of two volumes of v: voxels meet by their place, slices of unequal height or width are left out.

    gt and pr say whether a voxel is above 0, score is the predicted value.
    """
    by_slice = [*pair, "z"]
    size = lambda v: v.groupBy(*by_slice).agg(F.max("y").alias("h_"), F.max("x").alias("w_"))
    same = size(truth).join(size(predicted), [*by_slice, "h_", "w_"]).select(*by_slice)
    t = truth.select(*by_slice, "y", "x", (F.col("v") > 0).cast("int").alias("gt"))
    p = predicted.select(*by_slice, "y", "x", (F.col("v") > 0).cast("int").alias("pr"), F.col("v").alias("score"))
    return t.join(p, [*by_slice, "y", "x"]).join(same, by_slice, "left_semi")


def confusion(rows: DataFrame, *groups: str) -> DataFrame:
    return rows.groupBy(*groups).agg(*counts())


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scores(c: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1, iou, dice, mcc to tp, fp, fn, tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return c.select(
        "*",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        _ratio(tp, tp + fp + fn).alias("iou"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("dice"),
        _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def by_sample(rows: DataFrame, metric: Column, *sample: str) -> DataFrame:
    """One value for each sample, then their mean: ``value``."""
    return rows.groupBy(*sample).agg(metric.alias("m")).agg(F.avg("m").alias("value"))


def soft_dice(score: str = "score", gt: str = "gt", smooth: float = 1e-5) -> Column:
    return losses.dice(F.col(score), F.col(gt), smooth)


def hard_dice(score: str = "score", gt: str = "gt", threshold: float = 0.5, smooth: float = 1e-5) -> Column:
    p, t = (F.col(score) > threshold).cast("double"), (F.col(gt) > 0.5).cast("double")
    return losses.dice(p, t, smooth)


def iou(score: str = "score", gt: str = "gt", threshold: float = 0.5, smooth: float = 1e-5) -> Column:
    """Of the thresholded score."""
    return losses.iou((F.col(score) > threshold).cast("double"), (F.col(gt) > 0.5).cast("double"), smooth)


def ranged(points: DataFrame, ranges: int) -> DataFrame:
    """Adds r_, which rises with s_: ranges between approximate quantiles of s_, so each holds about as many rows however the values
    are clustered. The borders are one row of known size; a value finds its range by halving."""
    steps = (ranges - 1).bit_length()
    borders = points.agg(F.array_sort(F.array_distinct(F.percentile_approx("s_", [i / ranges for i in range(1, ranges)], 16 * ranges))).alias("b_"))
    # lo: so many borders are known to be at s_ or below, hi: not more than so many are
    start = F.struct(F.lit(0).alias("lo"), F.size("b_").alias("hi"))

    def halved(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"] + 1) / 2).cast("int")
        up = (at["lo"] < at["hi"]) & (F.get("b_", middle - 1) <= F.col("s_"))
        return F.struct(F.when(up, middle).otherwise(at["lo"]).alias("lo"), F.when(up | (at["lo"] >= at["hi"]), at["hi"]).otherwise(middle - 1).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, halved, lambda at: at["lo"])
    return points.crossJoin(F.broadcast(borders)).withColumn("r_", F.coalesce(found, F.lit(0))).drop("b_")  # one row


def average_precision(rows: DataFrame, *groups: str, score: str = "score", gt: str = "gt", ranges: int = 256) -> DataFrame:
    """groups, pr_auc: sum of (R_n - R_n-1) P_n over falling different scores; 0 without truth or with two scores at most.

    Scores beyond 1 are taken as parts of 255, which doesn't change their order. Counts of equal scores are summed first. The
    running sums are made within ranges of scores, on top of the sums of the ranges above, so that a group isn't one task's.
    """
    points = ranged(rows.groupBy(*groups, F.col(score).alias("s_")).agg(F.sum(gt).alias("p_"), F.count("*").alias("n_")), ranges)
    sums = points.groupBy(*groups, "r_").agg(F.sum("p_").alias("pr_"), F.sum("n_").alias("nr_"))
    above = Window.partitionBy(*groups).orderBy(F.desc("r_")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*groups, "r_", F.coalesce(F.sum("pr_").over(above), F.lit(0)).alias("pb_"), F.coalesce(F.sum("nr_").over(above), F.lit(0)).alias("nb_"))
    falling = Window.partitionBy(*groups, "r_").orderBy(F.desc("s_")).rowsBetween(Window.unboundedPreceding, 0)
    joined = points.join(before, [*groups, "r_"])
    curve = joined.select(*groups, "p_", (F.sum("p_").over(falling) + F.col("pb_")).alias("tp_"), (F.sum("n_").over(falling) + F.col("nb_")).alias("all_"))
    out = curve.groupBy(*groups).agg(F.sum(F.col("p_") * F.col("tp_") / F.col("all_")).alias("area_"), F.sum("p_").alias("truth_"), F.count("*").alias("scores_"))
    return out.select(*groups, F.when((F.col("truth_") > 0) & (F.col("scores_") > 2), F.col("area_") / F.greatest("truth_", F.lit(1))).otherwise(0.0).alias("pr_auc"))


def mean_of_valid(values: DataFrame, column: str) -> DataFrame:
    """One row: mean without nulls and NaN, 0 if none is left."""
    c = F.col(column)
    return values.agg(F.coalesce(F.avg(F.when(~F.isnan(c), c)), F.lit(0.0)).alias("value"))


def _pixels(make: Callable[..., Column]) -> Callable[..., DataFrame]:
    def values(rows: DataFrame, sample: list[str], smooth: float = 1e-5) -> DataFrame:
        return rows.groupBy(*sample).agg(make(smooth).alias("value"))

    return values


def _mcc(rows: DataFrame, sample: list[str]) -> DataFrame:
    return scores(confusion(_cut(rows), *sample)).select(*sample, F.col("mcc").alias("value"))


def _hausdorff(rows: DataFrame, sample: list[str], hd_percentile: float = 95.0) -> DataFrame:
    return hausdorff(_cut(rows), *sample, percentile=hd_percentile).withColumnRenamed("hausdorff", "value")


def _cldice(rows: DataFrame, sample: list[str]) -> DataFrame:
    from tessavox.operators import objects

    return objects.object_metrics(_cut(rows), *sample).select(*sample, F.col("cldice").alias("value"))


def _pr_auc(rows: DataFrame, sample: list[str]) -> DataFrame:
    return average_precision(rows, *sample).withColumnRenamed("pr_auc", "value")


def _cut(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pr", (F.col("score") > 0.5).cast("int"))


#: By the names used in configurations: (rows of gt and score, sample columns, parameters) -> sample, value.
METRICS: dict[str, Callable[..., DataFrame]] = {
    "dice_soft": _pixels(lambda smooth: soft_dice(smooth=smooth)),
    "dice_hard": _pixels(lambda smooth: hard_dice(smooth=smooth)),
    "iou": _pixels(lambda smooth: iou(smooth=smooth)),
    "bce": _pixels(lambda smooth: F.avg(losses.cross_entropy(F.col("score"), F.col("gt")))),
    "mcc": _mcc,
    "cldice": _cldice,
    "hausdorff": _hausdorff,
    "pr_auc": _pr_auc,
}


def named(name: str) -> tuple[str, Callable[..., DataFrame]] | None:
    """A metric by its name in any case; other names with ``dice`` in them are the hard or soft one; None with a warning for the rest."""
    low = name.lower()
    if low in METRICS:
        return low, METRICS[low]
    if "dice" in low:
        return low, METRICS["dice_hard" if "hard" in low else "dice_soft"]
    warnings.warn(f"unknown metric {name!r}", stacklevel=3)
    return None


def from_config(rows: DataFrame, names: str | list[str], parameters: dict[str, dict] | None = None, sample: tuple[str, ...] = ("z",)) -> DataFrame:
    """metric, value: the mean of each metric's valid values over the samples; parameters by metric, as in configurations."""
    known = [found for n in ([names] if isinstance(names, str) else names) if (found := named(n))]
    if not known:
        return rows.sparkSession.createDataFrame([], "metric string, value double")
    each = [mean_of_valid(make(rows, list(sample), **(parameters or {}).get(n, {})), "value").select(F.lit(n).alias("metric"), "value") for n, make in known]
    return functools.reduce(DataFrame.union, each)
