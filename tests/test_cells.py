"""Blocks along a curve, score ranges of clustered scores, chunks that arrive as a stream."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessavox.operators import metrics, stitch
from tessavox.sources import volumes
from tessavox.streaming import slices


def test_a_box_reads_its_cells_only(spark, tmp_path):
    to = str(tmp_path / "cells")
    vox = spark.range(32**3).select(F.expr("id DIV 1024").alias("z"), F.expr("(id DIV 32) % 32").alias("y"), F.expr("id % 32").alias("x"), F.col("id").cast("double").alias("v"))
    volumes.write_cells(vox, to, block=4, blocks_per_file=8)
    box = volumes.read_cells(spark, to, (8, 12), (16, 20), (20, 24))
    assert {(r.z, r.y, r.x): r.v for r in box.collect()} == {(z, y, x): float(z * 1024 + y * 32 + x) for z in range(8, 12) for y in range(16, 20) for x in range(20, 24)}
    # files whose least and greatest places meet the box, in each axis
    files = spark.read.parquet(to).groupBy(F.col("_metadata.file_path")).agg(*[f(c).alias(f"{c}{n}") for c in "zyx" for n, f in (("0", F.min), ("1", F.max))]).collect()
    met = [f for f in files if f.z0 < 12 and f.z1 >= 8 and f.y0 < 20 and f.y1 >= 16 and f.x0 < 24 and f.x1 >= 20]
    assert len(files) >= 64 and len(met) <= 4
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = volumes.read_cells(spark, to, (8, 12), (16, 20), (20, 24))._jdf.queryExecution().executedPlan().toString()
    assert all(f"GreaterThanOrEqual({c}," in plan for c in "zyx")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert volumes.read_cells(spark, to).count() == 32**3
    code = spark.createDataFrame([(5, 3, 6)], "z int, y int, x int").select(volumes.morton(1).alias("m")).first().m
    assert code == int("".join(b for t in zip("101", "011", "110", strict=True) for b in t), 2)


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_ranges_of_clustered_scores(spark, ranges):
    """99 % of the scores in a thousandth of their range: ranges stay even, the area right."""
    rng = np.random.default_rng(4)
    score = np.concatenate([rng.random(9900) / 1000 + 0.5, rng.random(100)])
    gt = (rng.random(10000) < score).astype(int)
    df = spark.createDataFrame([(float(s), int(g)) for s, g in zip(score, gt, strict=True)], "score double, gt int")
    points = metrics.ranged(df.select(F.col("score").alias("s_")), ranges)
    sizes = [r["count"] for r in points.groupBy("r_").count().collect()]
    assert len(sizes) == ranges and max(sizes) <= 1.2 * 10000 / ranges + 2
    order = points.orderBy("s_").select("r_").toPandas()["r_"]
    assert order.is_monotonic_increasing
    by = np.argsort(-score)
    tp = np.cumsum(gt[by])
    area = (gt[by] * tp / np.arange(1, 10001)).sum() / gt.sum()
    assert metrics.average_precision(df, ranges=ranges).first().pr_auc == pytest.approx(area)


def test_blended_stream_with_a_restart(spark, tmp_path):
    depth, size, overlap = 23, 8, 3
    vox = spark.range(depth * 5 * 4).select(F.expr("id DIV 20").alias("z"), F.expr("(id DIV 4) % 5").alias("y"), F.expr("id % 4").alias("x"), F.sin("id").alias("v"))
    chunks = stitch.chunked(vox, depth, size, overlap).withColumn("v", F.col("v") + F.col("z0") * 0.1).cache()
    starts = sorted(r.z0 for r in chunks.select("z0").distinct().collect())
    arrives, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(arrives)
        q = slices.blended(stream, depth, size, band=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema("z long, y long, x long, v double").parquet(out)

    for z0 in starts[:3]:
        chunks.where(F.col("z0") == z0).coalesce(1).write.mode("append").parquet(arrives)
        time.sleep(0.05)
    first = run()
    assert first.agg(F.max("z")).first()[0] == starts[2] - 1  # what no later chunk can change
    for z0 in starts[3:]:
        chunks.where(F.col("z0") == z0).coalesce(1).write.mode("append").parquet(arrives)
        time.sleep(0.05)
    chunks.where(F.col("z0") == starts[0]).coalesce(1).write.mode("append").parquet(arrives)  # comes too late
    got = {(r.z, r.y, r.x): r.v for r in run().collect()}
    wanted = {(r.z, r.y, r.x): r.v for r in stitch.blended(chunks).collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(v) for k, v in wanted.items())


def test_blended_stream_of_one_batch_in_many_groups(spark, tmp_path):
    """All chunks at once: groups are blocks of a band, not whole bands."""
    depth, size, overlap = 61, 8, 3
    vox = spark.range(depth * 20).select(F.expr("id DIV 20").alias("z"), F.expr("(id DIV 4) % 5").alias("y"), F.expr("id % 4").alias("x"), F.cos("id").alias("v"))
    chunks = stitch.chunked(vox, depth, size, overlap).withColumn("v", F.col("v") + F.col("z0") * 0.1).cache()
    arrives, out = str(tmp_path / "in"), str(tmp_path / "out")
    chunks.repartition(5).write.parquet(arrives)
    stream = slices.blended(spark.readStream.schema(chunks.schema).parquet(arrives), depth, size, band=2)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 3 * 8
    got = sorted((r.z, r.y, r.x, round(r.v, 9)) for r in spark.read.schema("z long, y long, x long, v double").parquet(out).collect())
    assert got == sorted((r.z, r.y, r.x, round(r.v, 9)) for r in stitch.blended(chunks).collect())
