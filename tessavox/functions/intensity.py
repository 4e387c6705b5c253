"""Scalar maps of voxel values, as column expressions: they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def clip(v: Column, low: float | None = None, high: float | None = None) -> Column:
    """Below low: low; else above high: high. Either bound may be left out."""
    out = v
    if high is not None:
        out = F.when(v > high, F.lit(float(high))).otherwise(out)
    if low is not None:
        out = F.when(v < low, F.lit(float(low))).otherwise(out)
    return out


def zscore(v: Column, mean: Column, std: Column, multiplier: float = 1.0) -> Column:
    return (v - mean) / (std * multiplier + EPS)


def minmax(v: Column, low: Column, high: Column) -> Column:
    """Not clamped: values beyond the range stay beyond [0, 1]."""
    return (v - low) / (high - low + EPS)


def minmax_gamma(v: Column, low: Column, high: Column, gamma: float) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), minmax(v, low, high)))
    return F.pow(clamped, F.lit(1.0 / (gamma + EPS)))


def equalized(v: Column, low: Column, high: Column, cdf: Column) -> Column:
    """v looked up in the array cdf over [low, high], with linear interpolation between entries."""
    bins = F.size(cdf)
    place = (v - low) / ((high - low) / (bins - 1) + 1e-12)
    i = F.floor(place).cast("int")
    weight = place - i
    between = (1 - weight) * F.get(cdf, i) + weight * F.get(cdf, i + 1)
    last = F.get(cdf, bins - 1)
    return F.when(v <= low, F.get(cdf, F.lit(0))).when(v >= high, last).when(i + 1 >= bins, last).otherwise(between)


def background(method: str, mean: Column | None = None, std: Column | None = None, low: Column | None = None, high: Column | None = None, gamma: float = 1.0, multiplier: float = 1.0, cdf: Column | None = None) -> Column:
    """What raw 0 becomes; here min-max is clamped."""
    zero = F.lit(0.0)
    if method == "z-score":
        return zscore(zero, mean, std, multiplier)
    if method == "min-max":
        return F.greatest(zero, F.least(F.lit(1.0), minmax(zero, low, high)))
    if method == "min-max-gamma":
        return minmax_gamma(zero, low, high, gamma)
    if method == "histogram":
        return F.get(cdf, F.lit(0))
    return zero


def binary(v: Column, threshold: float = 0.0) -> Column:
    return (v > threshold).cast("int")


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def logit_threshold(probability: float) -> float:
    """The logit at which the probability is passed; thresholds are held within [0.001, 0.999]."""
    if probability == 0.5:
        return 0.0
    t = min(max(probability, 0.001), 0.999)
    return -math.log(1.0 / t - 1.0)


#: Largest values of unsigned types; Spark has no such types, so results are int or long.
UNSIGNED = {"uint8": 255, "uint16": 65535}


def to_mask(v: Column, threshold: float, dtype: str = "uint8") -> Column:
    """The type's largest value where v passes the threshold, else 0."""
    return F.when(v > threshold, F.lit(UNSIGNED[dtype])).otherwise(F.lit(0))


def truncated(v: Column, kind: str = "int") -> Column:
    """Cast that cuts towards zero."""
    return v.cast(kind)
