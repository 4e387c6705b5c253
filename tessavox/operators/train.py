"""Training of a network on patches: one barrier stage for each epoch, gradients averaged over the whole batch.

Patches are rows of a key, split (``train`` or ``val``; others are left out), image and mask (flat arrays). A shard is a task:
patches belong to it by a hash of their key, and each epoch orders them anew by a hash; this is one shuffle of the patches
with a sort that spills. A task streams through its shard and holds its share of one batch. For each batch the tasks add up the
sums of which the losses are made, then the gradients: the loss of a batch is that of all its voxels, however many tasks share it.
Both go from task to task (``ring``). The driver sees one row an epoch with three vectors of the parameters' length: networks of some
million parameters; larger ones belong to a library for them.

An epoch ends with one row: its losses, metrics, parameters and the optimiser's moments, written below ``path``. A lost executor
restarts the epoch; a lost job goes on after the last epoch that was written. All is deterministic, restarts included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavox.operators import networks, predict
from tessavox.operators.lineage import exists, remove, shared_folder
from tessavox.operators.ring import Ring

_STATE = "train map<string,double>, val map<string,double>, rate double, step long, parameters array<double>, first array<double>, second array<double>"


def _terms(alpha: float, gamma: float) -> dict[str, Callable]:
    """Sums over voxels that losses are made of, as functions of logits, probabilities and targets: value, slope by the logit."""

    def entropy(z, p, t):
        return np.logaddexp(0, z) - t * z, p - t

    def focal(z, p, t):
        bce, slope = entropy(z, p, t)
        miss = -np.expm1(-bce)
        return alpha * miss**gamma * bce, alpha * (gamma * miss ** (gamma - 1) * (1 - miss) * bce + miss**gamma) * slope

    return {
        "n": lambda z, p, t: (np.ones_like(z), np.zeros_like(z)),
        "t": lambda z, p, t: (t, np.zeros_like(z)),
        "p": lambda z, p, t: (p, p * (1 - p)),
        "both": lambda z, p, t: (p * t, t * p * (1 - p)),
        "bce": entropy,
        "focal": focal,
        "hard": lambda z, p, t: (1.0 * (p > 0.5), np.zeros_like(z)),
        "hard_both": lambda z, p, t: ((p > 0.5) * t, np.zeros_like(z)),
    }


def _dice(s: dict[str, float], smooth: float = 1e-6) -> tuple[float, dict[str, float]]:
    top, low = 2 * s["both"] + smooth, s["p"] + s["t"] + smooth
    return 1 - top / low, {"both": -2 / low, "p": top / low**2}


def _tversky(s: dict[str, float], alpha: float = 0.5, beta: float = 0.5, smooth: float = 1e-6) -> tuple[float, dict[str, float]]:
    top = s["both"] + smooth
    low = top + alpha * (s["p"] - s["both"]) + beta * (s["t"] - s["both"])
    return 1 - top / low, {"both": -(low - top * (1 - alpha - beta)) / low**2, "p": top * alpha / low**2}


def _log_cosh_dice(s: dict[str, float], smooth: float = 1e-6) -> tuple[float, dict[str, float]]:
    d, slopes = _dice(s, smooth)
    return float(np.log(np.cosh(d))), {k: np.tanh(d) * v for k, v in slopes.items()}


def _mean(term: str) -> Callable:
    return lambda s, **_: (s[term] / s["n"], {term: 1 / s["n"]})


#: Losses by name, as functions of the sums over a batch: value, slopes by the sums.
LOSSES = {"dice": _dice, "tversky": _tversky, "log_cosh_dice": _log_cosh_dice, "bce": _mean("bce"), "focal": _mean("focal")}
METRICS = {
    "dice_soft": lambda s: (2 * s["both"] + 1e-5) / (s["p"] + s["t"] + 1e-5),
    "dice_hard": lambda s: (2 * s["hard_both"] + 1e-5) / (s["hard"] + s["t"] + 1e-5),
    "iou": lambda s: (s["hard_both"] + 1e-5) / (s["hard"] + s["t"] - s["hard_both"] + 1e-5),
    "bce": lambda s: s["bce"] / s["n"],
}


def scheduled(rate: float, losses: list[float], factor: float = 0.5, patience: int = 5, threshold: float = 1e-4) -> float:
    """The rate after these epochs: times factor whenever more than ``patience`` epochs in a row were no better than the best."""
    best, bad = float("inf"), 0
    for x in losses:
        best, bad = (x, 0) if x < best * (1 - threshold) else (best, bad + 1)
        if bad > patience:
            rate, bad = rate * factor, 0
    return rate


def _samples(batches: Iterator[pa.RecordBatch], shape: tuple[int, ...], vary: Callable | None, seed: tuple[int, int]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            val, key = b.column(0)[i].as_py(), b.column(3)[i].as_py()
            image, mask = (np.asarray(b.column(c)[i].values, np.float64).reshape(shape) for c in (1, 2))
            if vary is not None and not val:
                image, mask = vary(image, mask, np.random.default_rng([*seed, *key.encode()]))
            yield val, image, mask


def _epoch(shards: DataFrame, make: Callable, state: dict, shape: tuple[int, ...], share: int, steps: tuple[int, int], weights: dict[str, float], options: dict, metrics: tuple[str, ...], decay: float, clip: float | None, vary: Callable | None, seed: tuple[int, int]) -> DataFrame:
    """One row of _STATE: the epoch's results from the first task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, network = BarrierTaskContext.get(), make()
        ring = Ring(context)
        networks.load(network, np.array(state["parameters"]))
        size = sum(v.size for v in network.parameters.values())
        first, second, step, rate = np.array(state["first"]), np.array(state["second"]), state["step"], state["rate"]
        focal = options.get("focal", {})
        terms = _terms(focal.get("alpha", 0.8), focal.get("gamma", 2.0))
        rows, results = _samples(batches, shape, vary, seed), []
        ahead = next(rows, None)
        for val, count in enumerate(steps):
            sums: dict[str, float] = {}
            for _ in range(count):
                some = []
                while ahead is not None and ahead[0] == bool(val) and len(some) < share:
                    some.append(ahead[1:])
                    ahead = next(rows, None)
                own, memo = {k: (0.0, None) for k in terms}, None
                if some:
                    x, t = (np.stack(c) for c in zip(*some, strict=True))
                    z, memo = network.forward(x)
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    own = {k: f(z, p, t) for k, f in terms.items()}
                total = dict(zip(terms, ring.total(np.array([np.sum(v) for v, _ in own.values()])), strict=True))
                loss, slopes = 0.0, dict.fromkeys(terms, 0.0)
                for name, w in weights.items():
                    value, by = LOSSES[name](total, **({} if name == "focal" else options.get(name, {})))
                    loss += w * value
                    for k, v in by.items():
                        slopes[k] += w * v
                for k, v in {"loss": loss, **{m: METRICS[m](total) for m in metrics}}.items():
                    sums[k] = sums.get(k, 0.0) + float(v)
                if val:
                    continue
                gradient = np.zeros(size)
                if some:
                    gradient = networks.vector(network.backward(memo, sum(slopes[k] * own[k][1] for k in terms)), network.parameters)
                gradient = ring.total(gradient)
                if clip is not None:
                    gradient *= min(1.0, clip / (float(np.sqrt((gradient**2).sum())) + 1e-6))
                step += 1
                first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
                flat = networks.vector(network.parameters, network.parameters) * (1 - rate * decay)
                networks.load(network, flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8))
            results.append([(k, v / count) for k, v in sums.items()])
        ring.close()
        if context.partitionId() == 0:
            doubles, named = pa.list_(pa.float64()), pa.map_(pa.string(), pa.float64())
            flat = networks.vector(network.parameters, network.parameters)
            values = [(results[0], named), (results[1], named), (rate, pa.float64()), (step, pa.int64()), (flat, doubles), (first, doubles), (second, doubles)]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], [f.split(" ")[0] for f in _STATE.split(", ")])

    return shards.mapInArrow(run, _STATE, barrier=True)


def history(spark: SparkSession, path: str, epochs: int) -> DataFrame:
    """epoch, split, metric, value of the first epochs (from 1) below path; metrics only where they were taken."""
    rows = spark.read.parquet(*[f"{path}/epochs/{n}" for n in range(1, epochs + 1)])
    each = rows.select("epoch", F.explode(F.map_from_arrays(F.array(F.lit("train"), F.lit("val")), F.array("train", "val"))).alias("split", "m"))
    return each.select("epoch", "split", F.explode("m").alias("metric", "value"))


def fit(
    patches: DataFrame,
    path: str,
    shape: tuple[int, ...],
    model: str = "convolution",
    parameters: dict | None = None,
    key: str = "patch_id",
    epochs: int = 30,
    batch: int = 8,
    shards: int = 4,
    loss: dict[str, float] | None = None,
    options: dict[str, dict] | None = None,
    metrics: tuple[str, ...] = ("dice_soft", "iou"),
    metric_interval: int = 1,
    learning_rate: float = 1e-4,
    weight_decay: float = 1e-5,
    max_grad_norm: float | None = None,
    checkpoint_interval: int = 25,
    vary: Callable | None = None,
    seed: int = 0,
) -> DataFrame:
    """The history (epoch, split, metric, value) of a training that goes on after the last epoch found below path.

    AdamW, the rate halved on plateaus of the validation loss, gradients clipped to a norm if one is given. ``path/best`` holds the
    network of the least validation loss, ``path/epoch_25`` and so on that of every 25th epoch, both for
    ``predict.load_checkpoint``. An epoch's value is the mean over its batches. Losses and their options are those of
    ``functions.losses``. ``vary`` changes an image and its mask for training, by a generator that differs between patches and
    epochs (``augment.varied``). Needs as many free slots as shards, and a batch that shards divide. Without patches for
    validation the training loss stands in for theirs; without any for training there is nothing to fit, an error. Rows
    with a null in key, split, image or mask are left out.
    """
    spark, weights, options = patches.sparkSession, loss or {"bce": 1.0}, options or {}
    if unknown := (set(weights) - set(LOSSES)) | (set(metrics) - set(METRICS)):
        raise ValueError(f"unknown losses or metrics: {sorted(unknown)}")
    if batch % shards:
        raise ValueError(f"a batch of {batch} can't be dealt to {shards} shards")
    kind, given = networks.NETWORKS[model], parameters or {}
    network = kind(**given)
    digest = lambda *parts: F.md5(F.concat_ws(":", *parts, F.col("key_")))
    shard = (F.conv(F.substring(digest(F.lit(str(seed))), 1, 7), 16, 10).cast("long") % shards).cast("int")
    rows = patches.where(F.col("split").isin("train", "val")).select(F.col(key).cast("string").alias("key_"), (F.col("split") == "val").alias("val"), F.col("image").cast("array<double>").alias("image"), F.col("mask").cast("array<double>").alias("mask")).dropna()
    kept = shared_folder(spark, "patches")
    rows.withColumn("shard", shard).write.parquet(kept)
    try:
        held = spark.read.parquet(kept)
        most = dict(held.groupBy("val", "shard").count().groupBy("val").agg(F.max("count")).collect())  # two rows
        share = batch // shards
        if not most.get(False):
            raise ValueError("no patches for training")
        steps = (-(-most[False] // share), -(-most.get(True, 0) // share))
        zero = np.zeros(sum(v.size for v in network.parameters.values()))
        state = {"parameters": networks.vector(network.parameters, network.parameters).tolist(), "first": zero.tolist(), "second": zero.tolist(), "step": 0}
        past: list[float] = []
        for n in range(1, epochs + 1):
            place = f"{path}/epochs/{n}"
            if not exists(spark, f"{place}/_SUCCESS"):
                state["rate"] = scheduled(learning_rate, past)
                order = F.when(F.col("val"), digest(F.lit(str(seed)))).otherwise(digest(F.lit(str(seed)), F.lit(str(n))))
                dealt = held.repartitionById(shards, F.col("shard")).sortWithinPartitions("val", order, "key_").select("val", "image", "mask", "key_")
                taken = metrics if n % metric_interval == 0 else ()
                _epoch(dealt, lambda: kind(**given), state, shape, share, steps, weights, options, taken, weight_decay, max_grad_norm, vary, (seed, n)).withColumn("epoch", F.lit(n)).write.mode("overwrite").parquet(place)
            row = spark.read.parquet(place).first()  # one row
            state = {k: row[k] for k in ("parameters", "first", "second", "step")}
            now = (row.val or row.train)["loss"]
            networks.load(network, np.array(row.parameters))
            if not past or now < min(past):
                predict.save_checkpoint(spark, f"{path}/best", model, networks.stored(network), n, now)
            if n % checkpoint_interval == 0:
                predict.save_checkpoint(spark, f"{path}/epoch_{n}", model, networks.stored(network), n, now)
            past.append(now)
    finally:
        remove(spark, kept)
    return history(spark, path, epochs)
