"""Pictures for looking at: samples side by side, and curves of a training's history, as grey PNG files in a mounted folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessavox.operators.grouped import worked
from tessavox.sources import codecs
from tessavox.sources.volumes import WRITTEN, put


def _grey(a: np.ndarray) -> np.ndarray:
    low, high = a.min(), a.max()
    return np.round((a - low) / (high - low) * 255) if high > low else np.zeros_like(a)


def write_samples(samples: DataFrame, folder: str, gap: int = 2) -> DataFrame:
    """One picture for each sample, ``sample_{sample}.png``: its panels (0, 1, ...: image, mask, prediction) side by side, each from its
    least to its largest value.

    samples: sample, panel, y, x, v; for volumes choose a slice first (history.best_slice).
    """

    def work(sample: int, panel: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> list[tuple]:
        height, width = int(y.max()) + 1, int(x.max()) + 1
        out = np.full((height, (width + gap) * (int(panel.max()) + 1) - gap), 255.0)
        for p in np.unique(panel):
            one = np.zeros((height, width))
            here = panel == p
            one[y[here], x[here]] = v[here]
            out[:, p * (width + gap) : p * (width + gap) + width] = _grey(one)
        path = f"{folder}/sample_{sample}.png"
        return [(path, put(path, codecs.write_png(out.astype(np.uint8))))]

    return worked(samples, [F.col("sample")], ["panel", "y", "x", "v"], work, WRITTEN)


def write_curves(history: DataFrame, folder: str, height: int = 200, width: int = 320) -> DataFrame:
    """One picture for each metric, ``{metric}.png``: its values over the epochs as a dark line, least at the bottom.

    history: epoch, metric, value; epochs without a value are bridged.
    """

    def work(metric: str, epoch: np.ndarray, value: np.ndarray) -> list[tuple]:
        fine = np.isfinite(value)
        order = np.argsort(epoch[fine], kind="stable")
        e, v = epoch[fine][order], value[fine][order]
        out = np.full((height, width), 255, np.uint8)
        if len(e):
            at = np.interp(np.linspace(e[0], e[-1], width), e, v)
            row = height - 1 - np.round((at - v.min()) / max(v.max() - v.min(), 1e-12) * (height - 1)).astype(int)
            for x in range(width):
                a, b = sorted((row[max(0, x - 1)], row[x]))
                out[a : b + 1, x] = 0
        path = f"{folder}/{metric}.png"
        return [(path, put(path, codecs.write_png(out)))]

    return worked(history, [F.col("metric")], ["epoch", "value"], work, WRITTEN)
