import hashlib

import numpy as np
import pytest

from tessavox.operators import networks, predict, train


def _patches(spark, n=37, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        image = rng.normal(0, 1, 16)
        mask = (image + 0.3 * rng.normal(0, 1, 16) > 0.2).astype(float)
        rows.append((i, "val" if i % 4 == 0 else "train", image.tolist(), mask.tolist()))
    return spark.createDataFrame(rows, "patch_id long, split string, image array<double>, mask array<double>"), rows


def _values(df):
    return {(r.epoch, r.split, r.metric): r.value for r in df.collect()}


def _plain(rows, epochs, batch, shards, loss, rate, decay, clip, seed=0):
    """One process, gradients by differences: the linear network."""
    sha = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    shard = {r[0]: int(sha(seed, r[0])[:7], 16) % shards for r in rows}
    w, first, second, step, out, past = np.array([1.0, 0.0]), np.zeros(2), np.zeros(2), 0, {}, []

    def batches(split, order):
        lists = [sorted((r for r in rows if r[1] == split and shard[r[0]] == s), key=order) for s in range(shards)]
        share = batch // shards
        for at in range(0, max(map(len, lists)), share):
            some = [r for x in lists for r in x[at : at + share]]
            yield np.array([r[2] for r in some]), np.array([r[3] for r in some])

    for n in range(1, epochs + 1):
        now = train.scheduled(rate, past)
        told = []
        for x, t in batches("train", lambda r, n=n: (sha(seed, n, r[0]), str(r[0]))):
            told.append(loss(w, x, t))
            e = 1e-6
            g = np.array([(loss(w + d, x, t) - loss(w - d, x, t)) / (2 * e) for d in (np.array([e, 0]), np.array([0, e]))])
            if clip:
                g = g * min(1, clip / (np.linalg.norm(g) + 1e-6))
            step += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - now * decay * w - now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        out[n, "train"] = np.mean(told)
        out[n, "val"] = np.mean([loss(w, x, t) for x, t in batches("val", lambda r: (sha(seed, r[0]), str(r[0])))])
        past.append(out[n, "val"])
    return out, w


def _dice_and_entropy(w, x, t):
    p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
    return 0.5 * (1 - (2 * (p * t).sum() + 1e-6) / (p.sum() + t.sum() + 1e-6)) - np.mean(t * np.log(p) + (1 - t) * np.log(1 - p))


def test_many_tasks_train_like_one_process(spark, tmp_path):
    df, rows = _patches(spark)
    got = train.fit(df, str(tmp_path), (4, 4), "linear", epochs=3, batch=8, shards=2, loss={"dice": 0.5, "bce": 1.0}, learning_rate=0.05, weight_decay=0.01, max_grad_norm=0.1)
    want, w = _plain(rows, 3, 8, 2, _dice_and_entropy, 0.05, 0.01, 0.1)
    values = _values(got)
    for (n, split), v in want.items():
        assert values[n, split, "loss"] == pytest.approx(v, abs=1e-6)
    assert values[3, "val", "loss"] < values[1, "val", "loss"]
    model, stored = predict.load_checkpoint(spark, f"{tmp_path}/best")
    assert stored["epoch"] == 3 and model(np.array([2.0]))[0] == pytest.approx(2 * w[0] + w[1], abs=1e-5)


def test_shards_do_not_change_whole_batches_and_training_goes_on(spark, tmp_path):
    df, _ = _patches(spark)
    options = {"batch": 80, "loss": {"focal": 1.0}, "learning_rate": 0.05, "checkpoint_interval": 2, "metric_interval": 2}
    one = _values(train.fit(df, f"{tmp_path}/one", (4, 4), epochs=4, shards=1, **options))
    train.fit(df, f"{tmp_path}/two", (4, 4), epochs=2, shards=2, **options)
    two = _values(train.fit(df, f"{tmp_path}/two", (4, 4), epochs=4, shards=2, **options))
    assert one.keys() == two.keys() and one == pytest.approx(two, abs=1e-9)
    assert {n for n, _, m in one if m == "dice_soft"} == {2, 4}
    assert predict.load_checkpoint(spark, f"{tmp_path}/two/epoch_4")[1]["epoch"] == 4


@pytest.mark.parametrize("name", list(train.LOSSES))
@pytest.mark.parametrize("dimensions", [2, 3])
def test_slopes_of_losses_and_networks(name, dimensions):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (3, 4, 5, 5))
    t = (rng.random(x.shape) > 0.6).astype(float)
    net, terms = networks.Convolution(channels=3, dimensions=dimensions), train._terms(0.8, 2.0)
    options = {"alpha": 0.3, "beta": 0.7} if name == "tversky" else {}

    def loss(flat):
        networks.load(net, flat)
        z, memo = net.forward(x)
        p = 1 / (1 + np.exp(-z))
        own = {k: f(z, p, t) for k, f in terms.items()}
        value, slopes = train.LOSSES[name]({k: v.sum() for k, (v, _) in own.items()}, **options)
        return value, net.backward(memo, sum(s * own[k][1] for k, s in slopes.items()))

    flat = networks.vector(net.parameters, net.parameters)
    exact = networks.vector(loss(flat)[1], net.parameters)
    for i in range(0, flat.size, 7):
        d = np.zeros_like(flat)
        d[i] = 1e-6
        assert exact[i] == pytest.approx((loss(flat + d)[0] - loss(flat - d)[0]) / 2e-6, abs=1e-6)


def test_the_rate_is_halved_on_plateaus():
    assert train.scheduled(1.0, [1.0] + [1.0] * 5) == 1.0
    assert train.scheduled(1.0, [1.0] + [1.0] * 6) == 0.5
    assert train.scheduled(1.0, [1.0] * 13) == 0.25
    assert train.scheduled(1.0, [1 / n for n in range(1, 30)]) == 1.0


def test_odd_rows(spark, tmp_path):
    df, _ = _patches(spark, 5)
    more = spark.createDataFrame([(None, "train", [0.0] * 16, [0.0] * 16), (90, "test", [0.0] * 16, [0.0] * 16), (91, "train", None, [0.0] * 16)], df.schema)
    same = {"model": "linear", "epochs": 1, "shards": 2}
    assert _values(train.fit(df.union(more), f"{tmp_path}/a", (4, 4), **same)) == _values(train.fit(df, f"{tmp_path}/b", (4, 4), **same))
    alone = _values(train.fit(df.where("split = 'train'"), f"{tmp_path}/c", (4, 4), **same))
    assert {s for _, s, _ in alone} == {"train"}
    with pytest.raises(ValueError, match="no patches"):
        train.fit(df.limit(0), f"{tmp_path}/d", (4, 4), **same)
    with pytest.raises(ValueError, match="dealt"):
        train.fit(df, f"{tmp_path}/e", (4, 4), batch=7, shards=2)


@pytest.mark.parametrize("tasks", [1, 2, 3])
def test_sums_around_the_ring(spark, tasks):
    def run(batches):
        import pyarrow as pa
        from pyspark import BarrierTaskContext

        from tessavox.operators.ring import Ring

        for _ in batches:
            pass
        ring = Ring(BarrierTaskContext.get())
        large = ring.total(np.arange(300_000) * (ring.rank + 1.0))
        small = [ring.total(np.array([0.1 * ring.rank, 1.0])).tolist() for _ in range(50)]
        none = ring.total(np.array([]))
        ring.close()
        yield pa.RecordBatch.from_pydict({"large": [large.tolist()], "small": [small[-1]], "none": [len(none)]})

    rows = spark.range(0, 10, 1, tasks).mapInArrow(run, "large array<double>, small array<double>, none long", barrier=True).collect()
    assert len(rows) == tasks and len({tuple(r.small) for r in rows}) == 1
    factor = tasks * (tasks + 1) / 2
    assert all(r.none == 0 and r.small[1] == tasks and np.array_equal(r.large, np.arange(300_000) * factor) for r in rows)


def test_a_project_is_trained_and_its_model_used(spark, tmp_path):
    import pandas as pd

    from tessavox.plans import jobs
    from tessavox.sources import volumes

    rng = np.random.default_rng(5)

    def volume(a):
        z, y, x = (c.ravel() for c in np.indices(a.shape))
        return spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x, "v": a.ravel().astype(float)}))

    for name, depth in (("one", 4), ("two", 3)):
        bright = rng.random((depth, 12, 10)) > 0.7
        volumes.write_slices(volume(bright * 2.0 + rng.normal(0, 0.2, bright.shape)), f"{tmp_path}/{name}/images").count()
        volumes.write_slices(volume(bright * 255), f"{tmp_path}/{name}/labels").count()
    own = {"data_path": [str(tmp_path)], "save_path": f"{tmp_path}/out", "model_name": "net", "model_type": "convolution", "mask_name": "labels", "loss": {"dice": 1, "focal": 0.2},
           "metrics": ["dice_hard", "mcc"], "training_patch_size": [1, 8, 8], "training_overlay": [0, 2, 2], "training_epochs": 4, "training_batch_size": 4, "learning_rate": 0.1, "val_ratio": 0.25}
    config = {"model": {"convolution": {"channels": 3}}, "train": own}
    cut = jobs.training_patches(spark, config).collect()
    assert len(cut) == len({r.patch_id for r in cut}) == 7 * 4 and sum(r.split == "val" for r in cut) == 7
    assert all(len(r.image) == len(r.mask) == 64 and set(r.mask) <= {0.0, 1.0} for r in cut)
    with pytest.warns(UserWarning):
        values = _values(jobs.training(spark, config, shards=2))
    assert values[4, "val", "loss"] < values[1, "val", "loss"] and values[4, "val", "dice_hard"] > 0.8
    assert (tmp_path / "out" / "net" / "curves" / "val_loss.png").exists()
    config["inference"] = {"input_path": f"{tmp_path}/two", "output_path": f"{tmp_path}/masks", "model_path": f"{tmp_path}/out/net/best", "inference_patch_size": [1, 8, 8], "inference_overlay": [0, 2, 2], "preprocess": {"normalize_mode": "z-score"}}
    jobs.inference(spark, config)
    got = volumes.read_volume(spark, f"{tmp_path}/masks/images.scroll-tiff")
    right = got.join(volumes.read_volume(spark, f"{tmp_path}/two/labels").withColumnRenamed("v", "t"), ["z", "y", "x"])
    assert right.where("(v > 0) = (t > 0)").count() > 0.9 * 360


def test_variations_keep_masks_with_images():
    from tessavox.operators.augment import varied

    image = np.arange(24.0).reshape(2, 4, 3)
    for i in range(30):
        a, b = varied(image, image > 11, np.random.default_rng(i))
        c, _ = varied(image, image > 11, np.random.default_rng(i))
        assert np.array_equal(a, c) and a.shape == b.shape and set(np.unique(b)) <= {0.0, 1.0}
        assert b.sum() == 12 and (a[b > 0].mean() > a[b == 0].mean())
