"""Cutting the lineage of iterative operators, and fresh places, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder is made up for a session of one machine, but never on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessavox-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    _base(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, as a plain path where it is one of a mounted file system."""
    return re.sub("^file:/+", "/", f"{_base(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}")


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
