"""Normalisation of a whole volume by its own statistics: a one-row aggregate, broadcast back onto the voxels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessavox.functions import intensity
from tessavox.operators import stats

METHODS = ("z-score", "min-max", "min-max-gamma", "histogram")


def _mapping(source: DataFrame, method: str, gamma: float, multiplier: float, bins: int, range_: tuple[float, float] | None) -> tuple[DataFrame, Callable[[Column], Column]]:
    """One row of statistics of ``source``, and how they map a value."""
    one = stats.statistics(source).select(F.col("mean").alias("m_"), F.col("std").alias("s_"), F.col("min").alias("lo_"), F.col("max").alias("hi_"))
    m, s, lo, hi = (F.col(c) for c in ("m_", "s_", "lo_", "hi_"))
    if method == "histogram":
        low, high = range_ or (0.0, 255.0)
        one = one.crossJoin(F.broadcast(stats.cdf_array(stats.histogram(source, low, high, bins), bins)))
    return one, {
        "z-score": lambda v: intensity.zscore(v, m, s, multiplier),
        "min-max": lambda v: intensity.minmax(v, lo, hi),
        "min-max-gamma": lambda v: intensity.minmax_gamma(v, lo, hi, gamma),
        "histogram": lambda v: intensity.equalized(v, lo, hi, F.col("cdf")),
    }[method]


def normalized(vox: DataFrame, method: str, gamma: float = 1.0, multiplier: float = 1.0, bins: int = 256, range_: tuple[float, float] | None = None, of: DataFrame | None = None) -> DataFrame:
    """The volume with v mapped; statistics come from ``of`` (the volume itself by default).

    For histograms range_ is the range that is binned; the map itself runs over the actual minimum and maximum.
    An unknown method leaves the values as they are.
    """
    if method not in METHODS:
        return vox
    one, new = _mapping(vox if of is None else of, method, gamma, multiplier, bins, range_)
    # one row of a few numbers (and the bins)
    return vox.crossJoin(F.broadcast(one)).select(*[new(F.col("v")).alias("v") if c == "v" else F.col(c) for c in vox.columns])


def normalized_slices(slices: DataFrame, method: str, gamma: float = 1.0, multiplier: float = 1.0, bins: int = 256, range_: tuple[float, float] | None = None, of: DataFrame | None = None) -> DataFrame:
    """Slices with the values of ``data`` mapped in place: nothing is exploded but for the statistics, which come from the slices ``of``."""
    if method not in METHODS:
        return slices
    one, new = _mapping((slices if of is None else of).select(F.explode("data").alias("v")), method, gamma, multiplier, bins, range_)
    return slices.crossJoin(F.broadcast(one)).select(*[F.transform("data", new).alias("data") if c == "data" else F.col(c) for c in slices.columns])


def from_config(vox: DataFrame, registry: dict[str, dict], method: str, local: dict | None = None) -> DataFrame:
    """Parameters of the registry's entry for the method, overridden by local ones."""
    known = {"gamma", "multiplier", "bins", "range_"}
    options = {k: v for k, v in {**registry.get(method, {}), **(local or {})}.items() if k in known}
    return normalized(vox, method, **options)


def backgrounds(vox: DataFrame, gamma: float = 1.0) -> DataFrame:
    """method, background: what raw 0 becomes under each method."""
    one = stats.statistics(vox)
    c = {k: F.col(k) for k in ("mean", "std", "min", "max")}
    pairs = [F.struct(F.lit(m).alias("method"), intensity.background(m, c["mean"], c["std"], c["min"], c["max"], gamma).alias("background")) for m in METHODS[:3]]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
