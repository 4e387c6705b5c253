"""Losses and soft scores over columns of probabilities p and targets t, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sums(p: Column, t: Column) -> tuple[Column, Column, Column]:
    return F.sum(p * t), F.sum(p), F.sum(t)


def dice(p: Column, t: Column, smooth: float = 1e-6) -> Column:
    both, sp, st = _sums(p, t)
    return (2 * both + smooth) / (sp + st + smooth)


def iou(p: Column, t: Column, smooth: float = 1e-5) -> Column:
    both, sp, st = _sums(p, t)
    return (both + smooth) / (sp + st - both + smooth)


def dice_loss(p: Column, t: Column, smooth: float = 1e-6) -> Column:
    return 1 - dice(p, t, smooth)


def cross_entropy(p: Column, t: Column, clamp: float = 1e-7) -> Column:
    """Per row; average it for the score."""
    q = F.least(F.greatest(p, F.lit(clamp)), F.lit(1 - clamp))
    return -(t * F.log(q) + (1 - t) * F.log(1 - q))


def focal_loss(p: Column, t: Column, alpha: float = 0.8, gamma: float = 2.0) -> Column:
    bce = cross_entropy(p, t, 1e-12)
    return F.avg(alpha * F.pow(1 - F.exp(-bce), F.lit(gamma)) * bce)


def tversky_loss(p: Column, t: Column, alpha: float = 0.5, beta: float = 0.5, smooth: float = 1e-6) -> Column:
    """alpha weighs false positives, beta false negatives."""
    tp, fp, fn = F.sum(p * t), F.sum(p * (1 - t)), F.sum((1 - p) * t)
    return 1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)


def log_cosh_dice_loss(p: Column, t: Column, smooth: float = 1e-6) -> Column:
    return F.log(F.cosh(dice_loss(p, t, smooth)))


LOSSES = {
    "dice": dice_loss,
    "focal": focal_loss,
    "tversky": tversky_loss,
    "log_cosh_dice": log_cosh_dice_loss,
    "bce": lambda p, t: F.avg(cross_entropy(p, t, 1e-12)),
}


def combined(p: Column, t: Column, weights: dict[str, float], **options: dict) -> Column:
    """Weighted sum of losses by name; options hold keyword arguments of each."""
    if unknown := set(weights) - set(LOSSES):
        raise ValueError(f"unknown losses: {sorted(unknown)}")
    return sum((w * LOSSES[n](p, t, **options.get(n, {})) for n, w in weights.items()), F.lit(0.0))
