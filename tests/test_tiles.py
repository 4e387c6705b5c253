"""Objects of slices cut in tiles like those of whole slices."""

import numpy as np
import pytest

from tessavox.operators import objects


@pytest.mark.parametrize(("min_iou", "min_size", "connectivity"), [(0.5, 0, 2), (0.1, 4, 1)])
def test_like_whole_slices(spark, min_iou, min_size, connectivity):
    rng = np.random.default_rng(8)
    rows = []
    for z in range(10):
        height, width = rng.integers(3, 26, 2)
        gt = rng.random((height, width)) < (0 if z == 4 else 0.55)
        pr = gt ^ (rng.random((height, width)) < 0.06)
        if z == 5:  # a snake through all tiles
            gt[:] = False
            gt[::2] = True
            gt[1::4, -1] = gt[3::4, 0] = True
        rows += [("a", z, y, x, int(gt[y, x]), int(pr[y, x])) for y in range(height) for x in range(width)]
    df = spark.createDataFrame(rows, "volume string, z long, y int, x int, gt int, pr int")
    names = ["z", "gt_count", "pr_count", "matched", "obj_precision", "obj_recall", "obj_f1"]
    options = {"min_iou": min_iou, "min_size": min_size, "connectivity": connectivity}
    whole = objects.object_metrics(df, "volume", "z", **options).select(*names).orderBy("z").collect()
    got = objects.tiled_metrics(df, "volume", "z", tile=5, **options).select(*names).orderBy("z").collect()
    for a, b in zip(whole, got, strict=True):
        assert a[:4] == b[:4] and b[4:] == pytest.approx(a[4:])


def test_tiles_without_background(spark):
    """A tile that one object fills has all its pixels: without them the overlap of 7 of 15 pixels would count as enough."""
    rows = [(0, y, x, int(x < 4 and y < 3), int((x < 3 and y < 2) or (x == 3 and y == 0) or (x > 3 and y < 1))) for y in range(3) for x in range(7)]
    df = spark.createDataFrame(rows, "z long, y int, x int, gt int, pr int")
    names = ["z", "gt_count", "pr_count", "matched", "obj_precision", "obj_recall", "obj_f1"]
    whole = objects.object_metrics(df).select(*names).first()
    assert tuple(whole)[:4] == (0, 1, 1, 0) and tuple(objects.tiled_metrics(df, tile=3).select(*names).first()) == tuple(whole)


def test_no_rows(spark):
    df = spark.createDataFrame([], "z long, y int, x int, gt int, pr int")
    assert objects.tiled_metrics(df, tile=4).count() == 0
    assert objects.tiled_centre_dice(df, tile=4, halo=2).count() == 0


@pytest.mark.parametrize(("tile", "halo"), [(4, 2), (7, 6), (40, 16)])
def test_centre_lines_like_whole_slices(spark, tile, halo):
    rng = np.random.default_rng(9)
    rows = []
    for z in range(8):
        height, width = rng.integers(3, 34, 2)
        y, x = np.indices((height, width))
        gt = (np.sin(y / 3 + z) + np.cos(x / 4) > 0.1) & (rng.random((height, width)) < 0.97) & (z != 2)
        pr = np.roll(gt, 1, axis=0) | (rng.random((height, width)) < 0.02)
        if z == 3:
            gt[:], pr[:] = True, True
        rows += [("a", z, j, i, int(gt[j, i]), int(pr[j, i])) for j in range(height) for i in range(width)]
    df = spark.createDataFrame(rows, "volume string, z long, y int, x int, gt int, pr int")
    whole = objects.object_metrics(df, "volume", "z").select("z", "cldice").orderBy("z").collect()
    got = objects.tiled_centre_dice(df, "volume", "z", tile=tile, halo=halo).select("z", "cldice").orderBy("z").collect()
    assert [r.z for r in got] == [r.z for r in whole] and [r.cldice for r in got] == pytest.approx([r.cldice for r in whole])
    assert got[2].cldice == 0 and 0 < got[0].cldice < 1
