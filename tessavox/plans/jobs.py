"""The jobs that a project's configuration file describes: preprocessing, training, inference, conversion and evaluation of volumes in folders.

The driver lists directories and reads the configuration; slices are read, worked on and written by tasks.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavox.functions import intensity, paths
from tessavox.operators import augment, history, metrics, normalize, predict, report, stats, tiling, train
from tessavox.sources import convert, pictures, ranges, volumes


def directories(spark: SparkSession, root: str) -> DataFrame:
    """path of the root and all directories below it, on any file system. Mounted ones are listed by a task, others through an iterator; no
    list of files is held."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    todo, found = [fs.getFileStatus(top).getPath()], []
    if todo[0].toString().startswith("file:"):
        found = [(r.path,) for r in ranges.folders(spark, todo[0].toString()).toLocalIterator()]
        todo = []
    while todo:
        at = todo.pop()
        found.append((at.toString(),))
        inner = fs.listStatusIterator(at)
        while inner.hasNext():
            x = inner.next()
            if x.isDirectory():
                todo.append(x.getPath())
    return spark.createDataFrame(sorted(found), "path string")


def _normalised(config: dict, section: str, rows: DataFrame) -> DataFrame:
    """Slices clipped and normalised as the section's ``preprocess`` says, over the registry's defaults for the method."""
    own = config.get(section, {}).get("preprocess", {})
    if not own:
        warnings.warn(f"no preprocess block in {section!r}; defaults are used", stacklevel=3)
    method = own.get("normalize_mode", "z-score")
    given = {**config.get("normalization", {}).get(method, {}), **own}
    options = {to: given[name] for name, to in (("std_multiplier", "multiplier"), ("gamma", "gamma"), ("bins", "bins")) if name in given}
    if own.get("low_cut") is not None or own.get("high_cut") is not None:
        rows = rows.withColumn("data", F.transform("data", lambda v: intensity.clip(v, own.get("low_cut"), own.get("high_cut"))))
    rate = own.get("sample_rate", 1.0)
    return normalize.normalized_slices(rows, method, of=stats.sampled(rows, rate) if rate < 1 else None, **options)


def preprocess(spark: SparkSession, config: dict, source: str, target: str, section: str = "train") -> int:
    """Normalised slices under the names of their files; how many."""
    rows, names = _normalised(config, section, volumes.read_slices(spark, source)), volumes.slice_names(spark, source)
    if not ranges.reachable(target):
        return volumes.write_named(predict.to_voxels(rows), target, names).count()
    volumes.save_slices(rows.join(names, "z"), target)
    return names.count()


def training_patches(spark: SparkSession, config: dict) -> DataFrame:
    """patch_id, split, image, mask of all volumes called ``input_name`` below ``data_path`` that have masks called ``mask_name`` beside them.

    Patches with foreground are kept, and a share of as many others for each volume; the places of ``val_ratio`` of all
    go to validation. Volumes are numbered one after another, in the order of their paths.
    """
    own = config["train"]
    roots = [own["data_path"]] if isinstance(own["data_path"], str) else own["data_path"]
    size, overlap = tuple(own.get("training_patch_size", (16, 64, 64))), tuple(own.get("training_overlay", (0, 0, 0)))
    pad_mode, seed = own.get("preprocess", {}).get("pad_mode", "reflect"), own.get("seed", 0)
    every, before = None, 0
    for root in roots:
        pairs = paths.training_pairs(directories(spark, root.rstrip("/")), own.get("input_name", "images"), own.get("mask_name", "masks"))
        for r in pairs.sort("image").toLocalIterator():
            shape = volumes.shape_of(spark, r.image)
            if volumes.shape_of(spark, r.mask) != shape:
                raise ValueError(f"{r.image} and {r.mask} differ in size")
            sides = {"image": _normalised(config, "train", volumes.read_slices(spark, r.image)), "mask": volumes.read_slices(spark, r.mask)}
            image, mask = (predict.whole(predict.patches(rows, shape, size, overlap), shape, size, pad_mode).withColumnRenamed("data", name) for name, rows in sides.items())
            place = F.lit(before) + (F.col("pz") * shape[1] + F.col("py")) * shape[2] + F.col("px")
            marked = mask.select("pz", "py", "px", place.alias("patch_id"), F.exists("mask", lambda v: v > 0.5).alias("positive"), "mask")
            chosen = tiling.sampled_patches(marked.drop("mask"), own.get("training_neg_keep_ratio", 1.0), seed=seed)
            here = chosen.join(marked.select("patch_id", "mask"), "patch_id").join(image, ["pz", "py", "px"]).select("patch_id", "image", F.transform("mask", lambda v: (v > 0.5).cast("double")).alias("mask"))
            every = here if every is None else every.unionByName(here)
            before += shape[0] * shape[1] * shape[2]
    if every is None:
        raise ValueError(f"no pairs of images and masks below {roots}")
    split = tiling.split(every.select("patch_id"), own.get("val_ratio", 0.2), "patch_id", seed)
    return every.join(split, "patch_id").select("patch_id", "split", "image", "mask")


def training(spark: SparkSession, config: dict, shards: int | None = None) -> DataFrame:
    """The history of the training that the section ``train`` describes; its checkpoints lie below ``save_path/model_name``, curves of
    the validation there too if it is a mounted folder. ``model_type`` names one of ``networks.NETWORKS``, ``model`` its parameters."""
    own = config["train"]
    kind = own.get("model_type", "convolution")
    given = {k: v for k, v in config.get("model", {}).get(kind, {}).items() if k != "description"}
    size = tuple(own.get("training_patch_size", (16, 64, 64)))
    to, batch = f"{own['save_path'].rstrip('/')}/{own.get('model_name', kind)}", own.get("training_batch_size", 8)
    shards = shards or max(n for n in range(1, min(batch, spark.sparkContext.defaultParallelism) + 1) if batch % n == 0)
    names = [n.lower() for n in own.get("metrics", [])]
    if left := [n for n in names if n not in train.METRICS]:
        warnings.warn(f"not computed while training: {left}", stacklevel=2)
    losses = own.get("loss", {"bce": 1.0})
    out = train.fit(
        training_patches(spark, config), to, size[1:] if size[0] == 1 else size, kind, given, epochs=own.get("training_epochs", 30), batch=batch, shards=shards, loss=losses,
        options={k: v for k, v in config.get("loss", {}).items() if isinstance(v, dict)}, metrics=tuple(n for n in names if n in train.METRICS), metric_interval=own.get("metric_interval", 1),
        learning_rate=own.get("learning_rate", 1e-4), weight_decay=own.get("weight_decay", 1e-5), max_grad_norm=own.get("max_grad_norm"), vary=augment.varied, seed=own.get("seed", 0),
    )
    if "://" not in to:
        named = out.select("epoch", F.concat_ws("_", "split", "metric").alias("metric"), "value")
        pictures.write_curves(history.carried(named, named), f"{to}/curves").count()
    return out


def inference(spark: SparkSession, config: dict, model: predict.Model | None = None) -> dict[str, int]:
    """Masks of all directories called ``input_name`` below ``input_path``, written at the same places below ``output_path``; files by output.

    Without a model the checkpoint at ``model_path`` is loaded.
    """
    own = config["inference"]
    root = own["input_path"].rstrip("/")
    name = own.get("input_name", "images")
    output = own.get("output", {})
    kind = convert.KINDS[output.get("type", "Scroll-Tiff").lower()]
    options = convert.options_of(config.get("outputs", {}), output, kind)
    model = model or predict.load_checkpoint(spark, own["model_path"])[0]
    listed = directories(spark, root)
    top = listed.agg(F.min("path")).first()[0]
    done = {}
    for r in paths.named_directories(listed, name).sort("path").toLocalIterator():
        shape = volumes.shape_of(spark, r.path)
        size, overlap = tuple(own.get("inference_patch_size", (16, 64, 64))), tuple(own.get("inference_overlay", (2, 4, 4)))
        rows = _normalised(config, "inference", volumes.read_slices(spark, r.path))
        mask = predict.segmented_slices(rows, shape, size, overlap, model, method="none", dtype=output.get("dtype", "uint16"), pad_mode=own.get("preprocess", {}).get("pad_mode", "reflect"), batch=own.get("batch_size", 8))
        rest = r.path[len(top) :].rpartition("/")[0]
        to = own.get("output_path", root).rstrip("/") + rest
        done[to] = convert.write(predict.to_voxels(mask), kind, to, shape, own.get("output_name", name), output.get("dtype", "uint16"), **options)
    if not done:
        warnings.warn(f"no directories named {name!r} below {root}", stacklevel=2)
    return done


def conversion(spark: SparkSession, config: dict) -> dict[str, int]:
    """All tasks of the configuration's ``converter`` section; files by target and kind."""
    done = {}
    for task in config["converter"]:
        output = task.get("output", {})
        kinds = output.get("type", task.get("output_type"))
        places = {**({task["input_path"]: task["output_path"]} if "input_path" in task else {}), **task.get("input_output", {})}
        for kind in [kinds] if isinstance(kinds, str) else kinds:
            options = convert.options_of(config.get("outputs", {}), output, convert.KINDS[kind.lower()])
            if output.get("resize_shape"):
                options["shape"] = output["resize_shape"]
            if output.get("dtype"):
                options["dtype"] = output["dtype"]
            done |= convert.run(spark, {"inputs": list(places), "outputs": list(places.values()), "kinds": [kind], "options": options})
    return done


def evaluated(spark: SparkSession, root: str, parameters: dict[str, dict] | None = None) -> DataFrame:
    """parent_folder, image_folder, model_name and the columns of the detailed report for each truth folder and prediction beside it.

    Files meet by name (either spelling of the TIFF suffix); files without a partner, or of another size than it, are left out.
    """
    given = parameters or {}
    pairs = paths.evaluations(directories(spark, root))
    listed = pairs.collect()  # a row for each pair of the folders listed above
    names = ["parent_folder", "image_folder", "model_name"]
    if not listed:
        warnings.warn(f"no truth and prediction folders below {root}", stacklevel=2)
        return spark.createDataFrame([], ", ".join([f"{n} string" for n in names] + [f"{n} double" for n in report.DETAILED_COLUMNS]))
    pair = pairs.select(paths.file_name(F.col("parent")).alias("parent_folder"), F.col("image").alias("image_folder"), F.col("model").alias("model_name"), "gt", "prediction")

    def voxels(side: str, folders: list[str]) -> DataFrame:
        rows = volumes.slices(spark, folders).select(paths.parent(F.col("path")).alias(side), paths.file_name(F.col("path")).alias("name"), F.col("z").alias("page"), "y0", "x0", "width", F.posexplode("data").alias("i", "v"))
        placed = rows.select(side, "name", "page", (F.col("y0") + F.expr("i DIV width")).alias("y"), (F.col("x0") + F.expr("i % width")).alias("x"), "v")
        return placed.join(pair.select(*names, side), side).drop(side)

    truth, predicted = voxels("gt", sorted({r.gt for r in listed})), voxels("prediction", sorted({r.prediction for r in listed}))
    same = paths.matched_files(truth.select(*names, "name").distinct(), predicted.select(*names, "name").distinct(), *names)
    z = F.concat_ws("#", "gt_name", F.col("page").cast("string")).alias("z")
    t = truth.withColumnRenamed("name", "gt_name").select(*names, z, "y", "x", "v")
    p = predicted.withColumnRenamed("name", "pred_name").join(same, [*names, "pred_name"]).select(*names, z, "y", "x", "v")
    objects = given.get("object_metrics", {})
    return report.detailed(metrics.compared(t, p, *names), *names, hd_percentile=given.get("hausdorff", {}).get("hd_percentile", 95.0), min_iou=objects.get("min_iou", 0.5), min_size=objects.get("min_size", 0), connectivity=objects.get("connectivity") or 2)


def analysis(spark: SparkSession, root: str, name: str = "evaluation_report", config: dict | None = None) -> None:
    """The detailed report and the summary by model, as CSV below root/name."""
    details = evaluated(spark, root, (config or {}).get("metrics"))
    report.write(details, report.summary(details, "model_name"), f"{root.rstrip('/')}/{name}", "parent_folder", "image_folder", "model_name", model="model_name")
