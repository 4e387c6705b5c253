"""Augmentations of training patches, decided by a hash of the patch so that a rerun gives the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(key: Column, salt: int, seed: int = 0) -> Column:
    """A number in [0, 1) for each key, the same on any engine."""
    return F.pmod((key + seed + salt * 101) * 7919, F.lit(10_007)) / 10_007.0


def bias_field(k: Column, y: Column, x: Column, height: int, width: int, seed: int = 0, degree: int = 3, most: float = 0.1) -> Column:
    """A smooth positive field over a patch: exp of a sum of products of Legendre polynomials over [-1, 1], with coefficients in [0, most)."""

    def legendre(c: Column, n: int) -> list[Column]:
        t = c * (2.0 / max(1, n - 1)) - 1.0
        out = [F.lit(1.0), t]
        for i in range(2, degree + 1):
            out.append(((2 * i - 1) * t * out[-1] - (i - 1) * out[-2]) / i)
        return out

    py, px = legendre(y, height), legendre(x, width)
    terms = [(i, j) for i in range(degree + 1) for j in range(i + 1)]
    total = F.lit(0.0)
    for number, (i, j) in enumerate(terms):
        total += most * chance(k, 8 + number, seed) * py[i] * px[j]
    return F.exp(total)


def augmented(patches: DataFrame, key: str, height: int, seed: int = 0, width: int | None = None) -> DataFrame:
    """Flip along y (0.5), contrast (0.3, about the patch's mean), a smooth bias field (0.2), shift and scale by up to 0.2
    (0.3 each); the mask only flips and is cut at 0.5.

    patches: key, y, x, img, msk.
    """
    k = F.col(key)
    mean = patches.groupBy(key).agg(F.avg("img").alias("mean_"))
    gain = F.when(chance(k, 1, seed) < 0.3, 0.5 + chance(k, 2, seed)).otherwise(1.0)
    shift = F.when(chance(k, 3, seed) < 0.3, 0.4 * chance(k, 4, seed) - 0.2).otherwise(0.0)
    scale = F.when(chance(k, 5, seed) < 0.3, 0.8 + 0.4 * chance(k, 6, seed)).otherwise(1.0)
    y = F.when(chance(k, 0, seed) < 0.5, height - 1 - F.col("y")).otherwise(F.col("y"))
    field = F.when(chance(k, 7, seed) < 0.2, bias_field(k, y, F.col("x"), height, width or height, seed)).otherwise(1.0)
    img = (((F.col("img") - F.col("mean_")) * gain + F.col("mean_")) * field + shift) * scale
    return patches.join(mean, key).select(key, y.alias("y"), "x", img.alias("img"), (F.col("msk") > 0.5).cast("int").alias("msk"))


def varied(image: np.ndarray, mask: np.ndarray, rng: np.random.Generator, degree: int = 3, most: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """What ``augmented`` does, of one patch in a task: (height, width) or (depth, height, width)."""
    if rng.random() < 0.5:
        image, mask = image[..., ::-1, :], mask[..., ::-1, :]
    if rng.random() < 0.3:
        image = (image - image.mean()) * (0.5 + rng.random()) + image.mean()
    if rng.random() < 0.2:
        weights = np.tril(most * rng.random((degree + 1, degree + 1)))
        image = image * np.exp(np.polynomial.legendre.leggrid2d(*(np.linspace(-1, 1, n) for n in image.shape[-2:]), weights))
    if rng.random() < 0.3:
        image = image + (0.4 * rng.random() - 0.2)
    if rng.random() < 0.3:
        image = image * (0.8 + 0.4 * rng.random())
    return image, (mask > 0.5).astype(np.float64)
