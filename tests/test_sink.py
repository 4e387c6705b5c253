"""The sink of slices: all files or none, single files in places, overwriting, names."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessavox.sources import codecs, volumes

SLICES = "z long, height long, width long, data array<double>"


def rows(spark, a, parts=3):
    return spark.createDataFrame([(z, *p.shape, p.ravel().astype(float).tolist()) for z, p in enumerate(a)], SLICES).repartition(parts)


@pytest.fixture
def a():
    return np.random.default_rng(5).integers(0, 60000, (7, 5, 9)).astype("uint16")


@pytest.mark.parametrize("suffix", [".tif", ".nii", ".nii.gz", ".png"])
def test_a_file_for_each_slice(spark, tmp_path, a, suffix):
    to = str(tmp_path / "out")
    volumes.save_slices(rows(spark, a), to, suffix=suffix, dtype="uint16")
    assert sorted(os.listdir(to)) == [f"volume_{z:05d}{suffix}" for z in range(7)]
    got = np.concatenate([codecs.decode(open(f"{to}/{f}", "rb").read(), suffix) for f in sorted(os.listdir(to))])
    assert (got == a).all()


@pytest.mark.parametrize("suffix", [".tif", ".nii"])
def test_one_file_by_many_tasks(spark, tmp_path, a, suffix):
    volumes.save_slices(rows(spark, a, 4).where("z != 3 AND z != 6"), str(tmp_path), "single", suffix, "uint16", shape=a.shape)
    assert os.listdir(tmp_path) == [f"volume{suffix}"]
    wanted = a.copy()
    wanted[[3, 6]] = 0  # slices that aren't there are empty
    assert (codecs.decode((tmp_path / f"volume{suffix}").read_bytes(), suffix) == wanted).all()


def test_a_failed_task_leaves_nothing(spark, tmp_path, a):
    to = str(tmp_path / "out")
    bad = rows(spark, a, 7).withColumn("data", F.expr("CASE WHEN z = 5 THEN slice(data, 1, 4) ELSE data END"))
    for layout, shape in (("slices", None), ("single", a.shape)):
        with pytest.raises(Exception, match="reshape"):
            volumes.save_slices(bad, to, layout, ".tif", "uint16", shape=shape)
        assert not os.path.exists(to) or os.listdir(to) == []


def test_overwriting_and_names(spark, tmp_path, a):
    to = str(tmp_path)
    volumes.save_slices(rows(spark, a), to, dtype="uint16")
    volumes.save_slices(rows(spark, a[:2]), to, dtype="uint16", name="more")
    assert len(os.listdir(to)) == 9
    named = rows(spark, a[:3]).withColumn("name", F.concat(F.lit("s"), F.col("z"), F.lit(".png")))
    volumes.save_slices(named, to, dtype="uint16", mode="overwrite")
    assert sorted(os.listdir(to)) == ["s0.png", "s1.png", "s2.png"]
    with pytest.raises(Exception, match="one name"):
        volumes.save_slices(named.withColumn("name", F.lit("same.png")), to, dtype="uint16")
    assert sorted(os.listdir(to)) == ["s0.png", "s1.png", "s2.png"]


def test_what_a_single_file_needs(spark, tmp_path, a):
    for options, what in (({"suffix": ".tif"}, "shape"), ({"suffix": ".nii.gz", "shape": a.shape}, "suffix"), ({"suffix": ".tif", "shape": (1 << 20, 5000, 9)}, "can't hold"), ({"suffix": ".nii", "shape": (2, 5, 9)}, "doesn't fit")):
        with pytest.raises(Exception, match=what):
            volumes.save_slices(rows(spark, a), str(tmp_path), "single", **options)
    with pytest.raises(Exception, match="no layout"):
        volumes.save_slices(rows(spark, a), str(tmp_path), "cubes")
    with pytest.raises(Exception, match="need the columns"):
        volumes.save_slices(rows(spark, a).drop("height"), str(tmp_path))
    assert os.listdir(tmp_path) == []
