"""Operators against numpy and brute force, on small volumes and odd shapes."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessavox.functions import intensity, losses, paths
from tessavox.operators import distance, metrics, normalize, objects, pad, predict, report, resample, stats, stitch, tiling
from tessavox.plans.views import volume
from tessavox.queries import QUERIES


def frame(spark, a):
    rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(a) for i in [i]]
    return spark.createDataFrame(rows, "z long, y long, x long, v double")


def array(df, shape):
    out = np.full(shape, np.nan)
    seen = 0
    for r in df.collect():
        out[r.z, r.y, r.x] = r.v
        seen += 1
    assert seen == out.size
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 200), st.integers(1, 40), st.integers(0, 39))
def test_starts_cover_the_axis(full, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            tiling.starts(full, size, overlap)
        return
    found, at = [], 0
    while at + size < full:
        found.append(at)
        at += size - overlap
    last = max(0, full - size)
    found += [last] if last not in found else []
    assert tiling.starts(full, size, overlap) == sorted(found)
    assert {i for s in found for i in range(s, min(full, s + size))} == set(range(full))


@pytest.mark.parametrize("full,size,overlap", [(20, 6, 2), (5, 8, 3), (8, 8, 0), (17, 5, 4), (1, 1, 0), (9, 4, 1)])
def test_covering_by_arithmetic(spark, full, size, overlap):
    got = {r.c: sorted(r.s) for r in spark.range(full).select(F.col("id").alias("c"), tiling.covering(F.col("id"), full, size, overlap).alias("s")).collect()}
    assert got == {c: [s for s in tiling.starts(full, size, overlap) if s <= c < s + size] for c in range(full)}
    assert [r.start for r in tiling.z_plan(spark, full, size, overlap).orderBy("start").collect()] == tiling.starts(full, size, overlap)


@pytest.mark.parametrize("mode", ["edge", "reflect", "symmetric", "constant"])
@pytest.mark.parametrize("shape,pads", [((3, 4, 5), ((2, 3), (0, 9), (0, 0))), ((1, 2, 6), ((4, 5), (1, 1), (7, 0)))])
def test_pads_like_numpy(spark, mode, shape, pads):
    a = np.arange(np.prod(shape), dtype=float).reshape(shape)
    wanted = np.pad(a, pads, mode=mode, **({"constant_values": -3.0} if mode == "constant" else {}))
    assert (array(pad.padded(frame(spark, a), shape, pads, mode, -3.0), wanted.shape) == wanted).all()


def test_tile_and_stitch_give_the_volume_back(spark):
    a = np.random.default_rng(1).normal(size=(11, 7, 5))
    tiles = tiling.extracted(frame(spark, a), a.shape, (4, 3, 5), (1, 2, 0))
    assert np.allclose(array(stitch.patch_means(tiles, a.shape), a.shape), a)
    assert np.allclose(array(stitch.blended(stitch.chunked(frame(spark, a), 11, 4, 2)), a.shape), a)


def test_blend_is_an_ordered_fold(spark):
    chunks = [(0, 1.0), (3, 5.0), (4, 9.0)]
    df = spark.createDataFrame([(z0, 4, 0, 0, v) for z0, v in reversed(chunks)], "z0 long, z long, y long, x long, v double")
    assert stitch.blended(df).first().v == ((1.0 + 5.0) / 2 + 9.0) / 2


@pytest.mark.parametrize("new", [(5, 3, 8), (2, 9, 4), (1, 1, 1), (6, 4, 4)])
def test_nearest_and_linear(spark, new):
    a = np.random.default_rng(2).normal(size=(6, 4, 4))
    pick = np.ix_(*[resample.sources(n, m) for n, m in zip(a.shape, new, strict=True)])
    assert (array(resample.nearest(frame(spark, a), a.shape, new), new) == a[pick]).all()
    wanted = a
    for axis, (n, m) in enumerate(zip(a.shape, new, strict=True)):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        w = (at - low).reshape([-1 if i == axis else 1 for i in range(3)])
        wanted = np.take(wanted, low, axis) * (1 - w) + np.take(wanted, np.minimum(low + 1, n - 1), axis) * w
    assert np.allclose(array(resample.linear(frame(spark, a), a.shape, new), new), wanted)


def test_levels_stop_before_they_vanish():
    assert resample.levels((9, 8, 5), 6, 2) == [(9, 8, 5), (4, 4, 2), (2, 2, 1)]


def test_statistics_and_normalisers(spark):
    a = np.random.default_rng(3).normal(size=(4, 5, 6))
    s = stats.statistics(frame(spark, a)).first()
    assert np.allclose([s.mean, s.std, s.min, s.max, s.n], [a.mean(), a.std(), a.min(), a.max(), a.size])
    z = array(normalize.normalized(frame(spark, a), "z-score"), a.shape)
    assert np.allclose(z, (a - a.mean()) / (a.std() + 1e-8))
    assert (array(normalize.normalized(frame(spark, a), "unknown"), a.shape) == a).all()
    hist = np.histogram(a, 16, (-2, 2))[0]
    assert [r.n for r in stats.histogram(frame(spark, a), -2, 2, 16).orderBy("bin").collect()] == hist.tolist()
    flat = frame(spark, np.full((2, 2, 2), 7.0))
    assert stats.statistics(flat).first().std == 0


def test_empty_volume(spark):
    none = frame(spark, np.zeros((0, 1, 1))) if False else spark.createDataFrame([], "z long, y long, x long, v double")
    assert stats.statistics(none).first().n == 0
    assert normalize.normalized(none, "min-max").count() == 0
    assert [round(r.cdf, 2) for r in stats.cdf(stats.histogram(none, 0, 1, 3), 3).orderBy("bin").collect()] == [0.0, 0.5, 1.0]
    assert metrics.scores(metrics.confusion(none.selectExpr("1 AS gt", "1 AS pr"))).first().f1 == 0
    assert tiling.box(none, (0, 1), (0, 1), (0, 1)).count() == 0


def test_metrics_by_brute_force(spark):
    rng = np.random.default_rng(4)
    gt, score = rng.random((3, 6, 7)) > 0.6, np.round(rng.random((3, 6, 7)), 1)
    rows = [(*map(int, i), int(gt[i]), int(score[i] > 0.5), float(score[i])) for i in np.ndindex(gt.shape)]
    df = spark.createDataFrame(rows, "z long, y long, x long, gt int, pr int, score double")
    auc, hd = {r.z: r.pr_auc for r in metrics.average_precision(df, "z").collect()}, {r.z: r.hausdorff for r in metrics.hausdorff(df).collect()}
    for z in range(3):
        area = before = 0.0
        for t in sorted(set(score[z].ravel()), reverse=True):
            hit = score[z] >= t
            recall = (gt[z] & hit).sum() / gt[z].sum()
            area += (recall - before) * (gt[z] & hit).sum() / hit.sum()
            before = recall
        assert np.isclose(auc[z], area)
        g, p = np.argwhere(gt[z]), np.argwhere(score[z] > 0.5)
        d = np.sqrt(((g[:, None] - p[None]) ** 2).sum(-1))
        assert np.isclose(hd[z], max(np.percentile(d.min(1), 95), np.percentile(d.min(0), 95)))
    loss = df.agg(losses.dice_loss(F.col("score"), F.col("gt")).alias("l")).first().l
    assert np.isclose(loss, 1 - (2 * (score * gt).sum() + 1e-6) / (score.sum() + gt.sum() + 1e-6))


def flood(mask, connectivity):
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        out[start] = n
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if (connectivity == 2 or abs(dy) + abs(dx) == 1) and 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not out[q]:
                        out[q] = n
                        todo.append(q)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2]))
def test_labels_like_a_flood(seed, connectivity):
    mask = np.random.default_rng(seed).random((7, 9)) > 0.5
    assert (objects.labels(mask, connectivity) == flood(mask, connectivity)).all()


def test_objects_and_centre_lines():
    gt, pr = np.zeros((9, 12), bool), np.zeros((9, 12), bool)
    gt[1:4, 1:5] = gt[5:8, 7:11] = pr[1:4, 1:5] = True
    pr[0, 9] = True
    assert objects.matched(objects.labels(gt), objects.labels(pr)) == 1
    assert objects.labels(objects.without_small(objects.labels(pr), 2) > 0).max() == 1
    line = objects.thinned(gt)
    assert line.sum() and not (line & ~gt).any()
    assert objects.centre_dice(gt, gt) > 0.99 and objects.centre_dice(gt, np.zeros_like(gt)) == 0


def test_components_across_slices(spark):
    mask = np.random.default_rng(5).random((6, 6, 6)) > 0.8
    df = frame(spark, mask.astype(float)).where("v > 0")
    got: dict[int, set] = {}
    for r in objects.components(df).collect():
        got.setdefault(r.component, set()).add((r.z, r.y, r.x))
    left, wanted = set(map(tuple, np.argwhere(mask).tolist())), set()
    while left:
        todo, part = [left.pop()], set()
        while todo:
            p = todo.pop()
            part.add(p)
            near = {q for q in left if max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1}
            left -= near
            todo += near
        wanted.add(frozenset(part))
    assert {frozenset(s) for s in got.values()} == wanted


def test_long_components_stay_whole(spark):
    """A U whose arms are longer than any fixed number of rounds, joined only at the far end; and voxels at opposite edges that don't touch."""
    arms = [(z, 0, x) for z in range(210) for x in (2, 5)] + [(210, 0, x) for x in range(2, 6)]
    apart = [(300, 1, 0), (300, 0, (1 << 20) - 1)]
    df = spark.createDataFrame([(*p, 1.0) for p in arms + apart], "z long, y long, x long, v double")
    got = {(r.z, r.y, r.x): r.component for r in objects.components(df).collect()}
    assert len(got) == len(arms) + 2 and {got[p] for p in arms} == {2}
    assert len({got[p] for p in apart}) == 2


def test_components_of_the_whole_table(spark, data):
    """Like flooding the whole mask voxel by voxel."""
    vox = {(r.z, r.y, r.x) for r in volume(spark, data).where("v > 0.2").select("z", "y", "x").collect()}
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    wanted, left = [], set(vox)
    while left:
        todo, part = [left.pop()], []
        while todo:
            p = todo.pop()
            part.append(p)
            near = {q for s in steps if (q := (p[0] + s[0], p[1] + s[1], p[2] + s[2])) in left}
            left -= near
            todo += near
        z, y, x = min(part)
        wanted.append((((z << 20) + y << 20) + x, len(part), z, max(p[0] for p in part)))
    got = [(r.component, r.n, r.z_min, r.z_max) for r in QUERIES["volume_components"](spark, data).collect()]
    assert sorted(got) == sorted(wanted) and max(r[3] for r in got) > 60


def test_model_runs_in_batches(spark):
    a = np.random.default_rng(6).normal(size=(5, 4, 4))
    out = predict.segmented(frame(spark, a), a.shape, (3, 4, 3), (1, 0, 1), predict.MODELS["linear"](1.0, 0.0), probability=0.5)
    z = (a - a.mean()) / (a.std() + 1e-8)
    assert (array(out, a.shape) == np.where(z > 0, 255, 0)).all()
    assert intensity.logit_threshold(0.5) == 0 and intensity.logit_threshold(1.0) == pytest.approx(np.log(999))


def by_hand(a, size, overlap, model, band_free=True):
    """Chunk by chunk as one array: pads, patches, means, blends."""
    z = (a - a.mean()) / (a.std() + 1e-8)
    acc = np.full(a.shape, np.nan)
    real = [min(n, s) for n, s in zip(a.shape, size)]
    widths = [pad.widths(n, s, i == 0) for i, (n, s) in enumerate(zip(real, size))]
    for pz in tiling.starts(a.shape[0], size[0], overlap[0]):
        total, weight = np.zeros((real[0], *a.shape[1:])), np.zeros((real[0], *a.shape[1:]))
        for py in tiling.starts(a.shape[1], size[1], overlap[1]):
            for px in tiling.starts(a.shape[2], size[2], overlap[2]):
                patch = np.pad(z[pz : pz + size[0], py : py + size[1], px : px + size[2]], widths, "reflect")
                out = model(patch)[tuple(slice(w[0], w[0] + n) for w, n in zip(widths, real))]
                where = (slice(None), slice(py, py + real[1]), slice(px, px + real[2]))
                total[where] += out
                weight[where] += 1
        mean, here = total / weight, slice(pz, pz + real[0])
        acc[here] = np.where(np.isnan(acc[here]), mean, (acc[here] + mean) / 2)
    return acc


@pytest.mark.parametrize("shape, size, overlap", [((9, 7, 6), (4, 4, 3), (2, 1, 1)), ((3, 5, 9), (6, 8, 4), (2, 3, 0)), ((5, 6, 6), (1, 4, 4), (0, 2, 2))])
def test_chunks_pads_and_blends(spark, shape, size, overlap):
    a = np.random.default_rng(8).normal(size=shape)
    model = lambda batch: batch * 2 + np.arange(batch.shape[-1]) * 0.3 + np.arange(batch.shape[-2])[:, None] * 0.1
    pieces = predict.patches(normalize.normalized_slices(predict.to_slices(frame(spark, a)), "z-score"), shape, size, overlap)
    out = predict.stitched(predict.predicted(pieces, shape, size, model, batch=3, band=4), shape, lambda x: x, band=4)
    got = array(predict.to_voxels(out), shape)
    assert np.allclose(got, by_hand(a, size, overlap, lambda p: model(p[None])[0]), atol=1e-9)


def test_models_of_other_sizes_are_resized_back(spark):
    a = np.random.default_rng(9).normal(size=(4, 8, 8))
    half = lambda batch: batch[:, ::2, ::2, ::2]
    pieces = predict.patches(predict.to_slices(frame(spark, a)), a.shape, a.shape, (0, 0, 0))
    got = array(predict.to_voxels(predict.stitched(predict.predicted(pieces, a.shape, a.shape, half), a.shape, lambda x: x)), a.shape)
    at = np.abs((np.arange(8) + 0.5) / 2 - 0.5)
    at = np.where(at > 3, 6 - at, at)
    one = predict.resized_back(a[::2, ::2, ::2], a.shape)
    assert np.allclose(got, one)
    line = a[0, 0, ::2]
    assert np.allclose(predict.resized_back(line, (8,)), np.interp(at, np.arange(4), line))
    assert np.allclose(predict.resized_back(np.full((6, 5), 2.0), (3, 4)), 2.0) and predict.resized_back(np.arange(8.0), (4,))[1] == pytest.approx(2.5, abs=0.1)


def test_samples_are_transformed(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "k long, data array<double>")
    out = predict.transformed(rows, lambda batch: batch[:, ::-1] * 2, ["k"])
    assert {r.k: r.data for r in out.collect()} == {i: [2.0, 2.0 * i] for i in range(20)}
    assert tiling.squeezed(frame(spark, np.zeros((1, 2, 2))), 1).columns == ["y", "x", "v"] and "z" in tiling.squeezed(frame(spark, np.zeros((2, 2, 2))), 2).columns


def test_distances_like_all_pairs():
    rng = np.random.default_rng(10)
    for _ in range(60):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.02, 0.2, 0.7])
        if mask.any():
            y, x = np.nonzero(mask)
            yy, xx = np.indices(mask.shape)
            wanted = np.sqrt(((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2).min(-1))
            assert np.allclose(distance.distances(mask), wanted)
    assert distance.robust_hausdorff(np.zeros((1, 2, 2), bool), np.ones((1, 2, 2), bool)) == [None]


def test_registry(spark):
    rng = np.random.default_rng(11)
    rows = [(z, y, x, int(rng.random() < 0.4), float(rng.random())) for z in range(3) for y in range(6) for x in range(6)]
    df = spark.createDataFrame(rows, "z long, y long, x long, gt int, score double")
    with pytest.warns(UserWarning):
        got = {r.metric: r.value for r in metrics.from_config(df, ["clDice", "Hard_Dice2", "mydice", "nonsense", "iou"], {"iou": {"smooth": 1.0}}).collect()}
    assert set(got) == {"cldice", "hard_dice2", "mydice", "iou"}
    g = np.array([r[3] for r in rows]).reshape(3, 36)
    p = np.array([r[4] for r in rows]).reshape(3, 36) > 0.5
    assert got["iou"] == pytest.approx(np.mean([((a & b).sum() + 1) / ((a | b).sum() + 1) for a, b in zip(g == 1, p)]))
    assert got["hard_dice2"] == pytest.approx(np.mean([(2 * (a & b).sum() + 1e-5) / (a.sum() + b.sum() + 1e-5) for a, b in zip(g == 1, p)]))
    wanted = np.mean([objects.centre_dice((a == 1).reshape(6, 6), b.reshape(6, 6)) for a, b in zip(g, p)])
    assert got["cldice"] == pytest.approx(wanted)
    assert metrics.from_config(df, []).count() == 0


def test_report_of_all_columns(spark, tmp_path):
    rng = np.random.default_rng(12)
    masks = {(i, m, z): ((rng.random((7, 6)) < 0.5).astype(int), (rng.random((7, 6)) < 0.4).astype(int), rng.random((7, 6))) for i in "ab" for m in ("u", "v") for z in range(3)}
    masks["a", "u", 1] = (np.zeros((7, 6), int), *masks["a", "u", 1][1:])
    rows = [(i, m, z, y, x, int(g[y, x]), int(p[y, x]), float(s[y, x])) for (i, m, z), (g, p, s) in masks.items() for y in range(7) for x in range(6)]
    df = spark.createDataFrame(rows, "image string, model string, z long, y long, x long, gt int, pr int, score double")
    out = report.detailed(df, "image", "model")
    got = {(r.image, r.model): r for r in out.collect()}
    for (i, m), r in got.items():
        some = [masks[i, m, z][:2] for z in range(3)]
        labelled = [(objects.labels(g == 1), objects.labels(p == 1)) for g, p in some]
        assert r.pixels_total == 126 and r.files_evaluated == 3
        assert (r.gt_count, r.pr_count) == (sum(int(a.max()) for a, _ in labelled), sum(int(b.max()) for _, b in labelled))
        assert r.cldice == pytest.approx(np.mean([objects.centre_dice(g == 1, p == 1) for g, p in some]))
        f1 = []
        for a, b in labelled:
            hits = objects.matched(a, b) if a.any() and b.any() else 0
            f1.append(2 * hits / (a.max() + b.max()) if hits else 0.0)
        assert r.obj_f1 == pytest.approx(np.mean(f1))
        hd = [h for g, p in some if (h := distance.robust_hausdorff((g == 1)[None], (p == 1)[None])[0]) is not None]
        assert r.hausdorff == pytest.approx(np.mean(hd))
    report.write(out, report.summary(out), str(tmp_path), "image", "model")
    detailed = spark.read.option("header", True).csv(str(tmp_path / "detailed"))
    assert detailed.columns == ["image", "model", *report.DETAILED_COLUMNS] and detailed.count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).columns == ["model", *report.SUMMARY_COLUMNS]


def test_entropy(spark):
    assert stats.entropy(spark.createDataFrame([(0, 4), (1, 2), (2, 2), (3, 0)], "bin int, n long")).first().entropy == pytest.approx(1.5)


def test_precision_without_groups(spark):
    rng = np.random.default_rng(13)
    s, g = rng.integers(0, 50, 400) / 50, rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, g)], "score double, gt int")
    tp = n = area = 0.0
    for v in sorted(set(s), reverse=True):
        k = g[s == v].sum()
        tp, n = tp + k, n + (s == v).sum()
        area += k * tp / n
    for ranges in (1, 7, 1024):
        assert metrics.average_precision(df, ranges=ranges).first().pr_auc == pytest.approx(area / g.sum())


def test_paths(spark):
    names = ["/a/b.TIF", "/a/b.nii.gz", "/a/b.c.png", "/a/.hidden", "/a/b.txt", "b.gz", "/a/noend"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select(paths.suffix(F.col("path")).alias("s"), paths.volume_name(F.col("path")).alias("n")).collect()
    assert [r.s for r in rows] == [".tif", ".nii.gz", ".png", "", "", ".gz", ""]
    assert [r.n for r in rows] == ["b", "b", "b.c", ".hidden", "b", "b", "noend"]
    assert [paths.resolve(p) for p in ("/x.zarr/0", "/x.tif", "/dir")] == ["zarr", "file", "directory"]


def test_checkpoints(spark, tmp_path):
    predict.save_checkpoint(spark, str(tmp_path / "best"), "linear", {"weight": 2.0, "bias": 1.0}, 25, 0.5)
    model, stored = predict.load_checkpoint(spark, str(tmp_path / "best"))
    assert model(np.array([3.0]))[0] == 7.0 and stored["epoch"] == 25


@pytest.fixture(scope="module")
def whole(spark, data):
    rows = volume(spark, data).toPandas()
    out = np.full((int(rows.z.max()) + 1, 8, 8), np.nan)
    out[rows.z, rows.y, rows.x] = rows.v
    assert len(rows) == out.size
    return out


@pytest.mark.parametrize("mode", pad.MODES)
def test_whole_volume_padded(spark, data, whole, mode):
    wanted = np.pad(whole, ((6, 6), (0, 4), (0, 11)), mode, **({"constant_values": -1.0} if mode == "constant" else {}))
    assert np.allclose(array(QUERIES[f"pad_{mode}"](spark, data), wanted.shape), wanted, atol=1e-6)


def test_whole_volume_padded_to_multiple(spark, data, whole):
    d = -len(whole) % 32
    wanted = np.pad(whole, ((d // 2, d - d // 2), (12, 12), (12, 12)), constant_values=0.25)
    assert np.allclose(array(QUERIES["pad_to_multiple"](spark, data), wanted.shape), wanted, atol=1e-6)


def test_whole_volume_resized(spark, data, whole):
    new = (len(whole) * 33 // 20, 5, 11)
    at = [np.minimum(a - 1, np.floor((np.arange(b) + 0.5) * a / b)).astype(int) for a, b in zip(whole.shape, new, strict=True)]
    assert np.allclose(array(QUERIES["resize_nn"](spark, data), new), whole[np.ix_(*at)], atol=1e-6)
    p = np.clip((np.arange(13) + 0.5) * 8 / 13 - 0.5, 0, 7)
    w = np.maximum(0, 1 - np.abs(p[:, None] - np.arange(8)))
    assert np.allclose(array(QUERIES["resize_linear"](spark, data), (len(whole), 13, 13)), np.einsum("zyx,py,qx->zpq", whole, w, w), atol=1e-6)
