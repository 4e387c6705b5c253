"""File names as columns: suffixes, volume names, discovery of volumes and pairs in listings of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: suffixes of readable volumes.
SUFFIXES = (".tif", ".tiff", ".nii", ".nii.gz", ".gz", ".png", ".jpg")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Lower case; ``.nii.gz`` counts as one, unknown suffixes are empty. A leading dot begins no suffix."""
    low = F.lower(F.regexp_replace(file_name(path), "^[.]+", "_"))
    last = F.regexp_extract(low, r"(\.nii\.gz|\.[^.]*)$", 1)
    return F.when(last.isin(*SUFFIXES), last).otherwise(F.lit(""))


def volume_name(path: Column) -> Column:
    name = file_name(path)
    return F.when(suffix(path) == ".nii.gz", F.substring(name, F.lit(1), F.char_length(name) - 7)).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def is_zarr(path: Column) -> Column:
    return F.contains(path, F.lit(".zarr"))


def stacks(files: DataFrame, path: str = "path") -> DataFrame:
    """dir, path, suffix, idx of the readable files: of each directory those with the suffix of its first one by name."""
    known = files.select(parent(F.col(path)).alias("dir"), F.col(path).alias("path"), suffix(F.col(path)).alias("suffix")).where("suffix != ''")
    by_name = Window.partitionBy("dir").orderBy("path")
    first = known.groupBy("dir").agg(F.min_by("suffix", "path").alias("suffix"))
    return known.join(first, ["dir", "suffix"]).withColumn("idx", F.row_number().over(by_name) - 1)


def resolve(path: str) -> str:
    """How a path is read: ``zarr``, ``file`` by suffix, or ``directory``."""
    if ".zarr" in path:
        return "zarr"
    low = path.lower()
    return "file" if any(low.endswith(s) for s in SUFFIXES) else "directory"


def training_pairs(dirs: DataFrame, input_name: str, mask_name: str, path: str = "path") -> DataFrame:
    """rel, image, mask: directories called input_name that have a sibling mask directory at the same place."""
    last, up = file_name(F.col(path)), parent(F.col(path))
    named = lambda name, alias: dirs.where(last == name).select(up.alias("rel"), F.col(path).alias(alias))
    return named(input_name, "image").join(named(mask_name, "mask"), "rel")


def named_directories(dirs: DataFrame, name: str, path: str = "path") -> DataFrame:
    """Directories of a name, wherever they are."""
    return dirs.where(file_name(F.col(path)) == name).select(F.col(path).alias("path"))


def evaluations(dirs: DataFrame, path: str = "path") -> DataFrame:
    """parent, image, model, gt, prediction: each ``*_mask`` directory with the ``{image}_{model}_mask`` scroll folders beside it."""
    d = dirs.select(parent(F.col(path)).alias("parent"), file_name(F.col(path)).alias("name"), F.col(path).alias("path"))
    gt = d.where(F.col("name").endswith("_mask")).select("parent", F.regexp_replace("name", "_mask$", "").alias("image"), F.col("path").alias("gt"))
    pred = d.where(F.col("name").rlike(r"_mask\.scroll-tiff?$")).select("parent", F.regexp_replace("name", r"_mask\.scroll-tiff?$", "").alias("stem"), F.col("path").alias("prediction"))
    both = gt.join(pred, "parent").where(F.col("stem").startswith(F.concat("image", F.lit("_"))))
    return both.select("parent", "image", F.expr("substring(stem, char_length(image) + 2)").alias("model"), "gt", "prediction")


def matched_files(truth: DataFrame, predicted: DataFrame, *by: str) -> DataFrame:
    """by, gt_name, pred_name: rows of name columns joined by name, else by the other spelling of the TIFF suffix; unmatched ones are dropped."""
    other = F.when(F.col("name").endswith(".tif"), F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(".tiff"))).otherwise(F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(".tif")))
    t = truth.select(*by, F.col("name").alias("gt_name"), F.col("name"), other.alias("other"))
    keys = t.select(*by, "gt_name", F.lit(0).alias("rank"), F.col("name").alias("key")).union(t.select(*by, "gt_name", F.lit(1), "other"))
    hits = keys.join(predicted.select(*by, F.col("name").alias("key")).distinct(), [*by, "key"])
    return hits.groupBy(*by, "gt_name").agg(F.min_by("key", "rank").alias("pred_name"))
