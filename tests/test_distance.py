"""Distances to masks: all pairs on small ones, slices of real size in seconds, strips like whole slices."""

import time

import numpy as np
import pytest

from tessavox.operators import distance


def all_pairs(mask):
    y, x = np.nonzero(mask)
    rows, columns = np.indices(mask.shape)
    return np.sqrt(((rows[..., None] - y) ** 2 + (columns[..., None] - x) ** 2).min(axis=-1))


@pytest.mark.parametrize("seed", range(20))
def test_like_all_pairs(seed):
    rng = np.random.default_rng(seed)
    shape = tuple(rng.integers(1, 24, 2))
    stack = rng.random((5, *shape)) < rng.choice([0.02, 0.2, 0.7])
    stack[0] = False
    stack[0, 0, -1] = True
    for mask, got in zip(stack, distance.distances(stack), strict=True):
        if mask.any():
            assert np.allclose(got, all_pairs(mask))
        else:
            assert np.isinf(got).all()
            assert (distance.squared(mask[None]) == distance.FAR).all()


def test_rows_in_blocks(monkeypatch):
    monkeypatch.setattr(distance, "TOGETHER", 64)
    mask = np.random.default_rng(1).random((3, 30, 17)) < 0.1
    assert all(np.allclose(distance.distances(m), all_pairs(m)) for m in mask if m.any())


@pytest.mark.parametrize("what", ["empty", "tiny", "dense"])
def test_a_slice_of_43_million_pixels(what):
    mask = np.zeros((1, 5841, 7331), bool)
    if what == "tiny":
        mask[0, 100:103, 200:203] = True
    if what == "dense":
        mask[0, ::7, ::5] = True
    other = np.zeros_like(mask)
    other[0, 5000:5003, 7000:7003] = True
    began = time.perf_counter()
    (found,) = distance.robust_hausdorff(mask, other)
    assert time.perf_counter() - began < 60
    if what == "empty":
        assert found is None
    if what == "tiny":
        assert found == pytest.approx(np.hypot(4900, 6800), abs=4)


def test_work_grows_with_the_pixels():
    """Twice the sides, about four times the time, whatever the mask."""
    took = []
    for side in (700, 1400):
        mask = np.zeros((1, side, side), bool)
        mask[0, side // 2, ::50] = True
        best = []
        for _ in range(3):
            began = time.perf_counter()
            distance.squared(mask)
            best.append(time.perf_counter() - began)
        took.append(min(best))
    assert took[1] < 12 * took[0]


def test_strips_like_whole_slices(spark):
    rng = np.random.default_rng(3)
    rows = []
    for z in range(8):
        height, width = rng.integers(1, 30, 2)
        gt, pr = (rng.random((height, width)) < (0 if z == 5 and k else 0.1) for k in range(2))
        rows += [("v" if z % 2 else "w", z, y, x, int(gt[y, x]), int(pr[y, x])) for y in range(height) for x in range(width)]
    df = spark.createDataFrame(rows, "volume string, z long, y int, x int, gt int, pr int")
    whole = {(r.volume, r.z): r.hausdorff for r in distance.hausdorff(df, "volume", "z").collect()}
    for tile in (1, 4, 100):
        got = {(r.volume, r.z): r.hausdorff for r in distance.hausdorff(df, "volume", "z", tile=tile).collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(v) for k, v in whole.items())
    assert distance.hausdorff(df.limit(0), "volume", "z", tile=4).count() == 0


def test_percentiles():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 50):
        d2 = rng.integers(0, 90, n)
        for q in (0, 33.3, 50, 95, 100):
            assert distance._percentile(d2, q) == pytest.approx(np.percentile(np.sqrt(d2), q))
