"""Volumes in long form: one row (z, y, x, v) for each voxel, and how the tables give such volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(rows: DataFrame, z: str, data: str, width: int) -> DataFrame:
    """Rows that hold one slice each as a flat array, as z, y, x (long) and v (double)."""
    long = rows.select(F.col(z).cast("long").alias("z"), F.posexplode(data).alias("i", "v"))
    return long.select("z", F.expr(f"CAST(i DIV {width} AS BIGINT)").alias("y"), F.expr(f"CAST(i % {width} AS BIGINT)").alias("x"), F.col("v").cast("double").alias("v"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table embeddings as a volume: z is the row's id, each vector a slice of 8 x 8."""
    return voxels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH)


def truth_and_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, gt, pr, score: the volume's bright voxels as truth, a threshold on the mean of each voxel and its right
    neighbour as prediction, that mean squeezed into (0, 1) as score."""
    right = F.lead("v").over(_row_window())
    score = 1 / (1 + F.exp(-4 * (F.col("v") + F.coalesce(right, F.col("v"))) / 2))
    return volume(spark, sf_dir).withColumn("score", score).select("z", "y", "x", F.expr("CAST(v > 0.1 AS INT)").alias("gt"), F.expr("CAST(score > 0.58 AS INT)").alias("pr"), "score")


def _row_window():
    from pyspark.sql import Window

    return Window.partitionBy("z", "y").orderBy("x")
