"""Formats, readers, writers, conversion tasks and streams."""

import gzip
import json

import numpy as np
import pytest
from test_volume import array, frame

from tessavox.functions import paths
from tessavox.operators import predict, report, stats
from tessavox.plans import jobs
from tessavox.plans.session import session
from tessavox.sources import codecs, convert, pictures, volumes
from tessavox.streaming import slices


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4", "f8"])
def test_codecs_round_trip(dtype):
    a = (np.random.default_rng(1).random((3, 5, 7)) * 200).astype(dtype)
    assert (codecs.read_tiff(codecs.write_tiff(a)) == a).all()
    assert (codecs.read_nifti(codecs.write_nifti(a)) == a).all()
    assert (codecs.read_nifti(codecs.write_nifti(a, True)) == a).all()
    if dtype in ("u1", "u2"):
        assert (codecs.read_png(codecs.write_png(a[0])) == a[:1]).all()
    for how in codecs.COMPRESSORS:
        meta = json.loads(codecs.zarr_metadata((3, 5, 7), (4, 5, 8), dtype, how))
        assert (codecs.read_chunk(codecs.write_chunk(a, (4, 5, 8), how), meta)[:3, :, :7] == a).all()
    for suffix, data in ((".tif", codecs.write_tiff(a)), (".nii", codecs.write_nifti(a)), (".nii.gz", codecs.write_nifti(a, True))):
        assert codecs.header(data, suffix) == (3, 5, 7, a.dtype.name)
    if dtype in ("u1", "u2"):
        assert codecs.header(codecs.write_png(a[0]), ".png") == (1, 5, 7, a.dtype.name)


def test_blosc_frames_of_several_split_blocks():
    """A frame as the format's library makes it: blocks of 1 kB, a stream for each byte of an item, a shorter last block."""
    import struct

    import pyarrow as pa

    a = (np.random.default_rng(2).random(1100) * 50).astype("<u2")
    data, block, out, starts = a.tobytes(), 1024, b"", []
    count = -(-len(data) // block)
    for i in range(count):
        part = data[i * block : (i + 1) * block]
        shuffled = np.frombuffer(part, np.uint8).reshape(-1, 2).T.tobytes()
        starts.append(16 + 4 * count + len(out))
        half = len(shuffled) // 2
        for stream in [shuffled[:half], shuffled[half:]] if len(part) == block else [shuffled]:
            packed = pa.Codec("lz4_raw").compress(stream, asbytes=True)
            packed = packed if len(packed) < len(stream) else stream
            out += struct.pack("<i", len(packed)) + packed
    frame_ = struct.pack("<BBBBIII", 2, 1, 1 << 5 | 1, 2, len(data), block, 16 + 4 * count + len(out)) + struct.pack(f"<{count}I", *starts) + out
    assert codecs.blosc_unpacked(frame_) == data


def _by_java(spark, a, path, kind, compression=None):
    """A grey image written by the JDK."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 10)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            image.getRaster().setSample(x, y, 0, int(a[y, x]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    how = writer.getDefaultWriteParam()
    if compression:
        how.setCompressionMode(2)
        how.setCompressionType(compression)
    to = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(path))
    writer.setOutput(to)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    to.close()


def test_images_of_other_programs(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = np.repeat(rng.integers(0, 255, (40, 10)), 5, axis=1)
    a[20:] = rng.integers(0, 255, (20, 50))  # enough different codes for wider ones
    _by_java(spark, a, str(tmp_path / "l.tif"), "tiff", "LZW")
    assert (codecs.read_tiff((tmp_path / "l.tif").read_bytes())[0] == a).all()
    flat = np.full((16, 24), 80)
    flat[:, 12:] = 160
    (tmp_path / "stack").mkdir()
    for i in range(3):
        _by_java(spark, flat + i, str(tmp_path / "stack" / f"s_{i:05d}.jpg"), "jpg")
    got = array(volumes.read_volume(spark, str(tmp_path / "stack")), (3, 16, 24))
    assert np.abs(got - np.stack([flat, flat + 1, flat + 2])).max() <= 3
    assert volumes.shape_of(spark, str(tmp_path / "stack")) == (3, 16, 24)
    assert volumes.read_volume(spark, str(tmp_path / "stack"), z=(1, 2)).agg({"z": "min", "v": "count"}).collect()[0].asDict() == {"min(z)": 1, "count(v)": 384}


def test_ranges_read_only_their_files(spark, tmp_path):
    a = np.random.default_rng(4).normal(size=(23, 4, 5)).astype(np.float32).astype(float)
    volumes.write_chunks(frame(spark, a), str(tmp_path / "c"), 23, 5).count()
    volumes.write_zarr(frame(spark, a), str(tmp_path / "c.zarr"), a.shape, (5, 4, 3)).count()
    part = frame(spark, a[7:13]).selectExpr("z + 7 AS z", "y", "x", "v")
    (tmp_path / "c" / "volume_z20-23.tif").write_bytes(b"II*\0" + (tmp_path / "c" / "volume_z20-23.tif").read_bytes()[4:-30])  # its last pixels are gone
    for path in ("c", "c.zarr"):
        got = volumes.read_volume(spark, str(tmp_path / path), z=(7, 13))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, part.select("z", "y", "x", "v").collect()))
        assert volumes.read_volume(spark, str(tmp_path / path), z=(40, 50)).count() == 0
    assert volumes.shape_of(spark, str(tmp_path / "c.zarr")) == (23, 4, 5)


def test_single_files(spark, tmp_path):
    a = np.random.default_rng(5).normal(size=(6, 4, 5)).astype(np.float32).astype(float)
    a[2] = a[5] = 0
    vox = frame(spark, a).where("z NOT IN (2, 5)")
    for suffix in (".tif", ".nii.gz", ".nii"):
        volumes.write_single(vox, str(tmp_path / suffix[1:4]), a.shape, suffix=suffix).count()
        (file,) = [p for p in (tmp_path / suffix[1:4]).iterdir() if p.name.endswith(suffix)]
        assert (array(volumes.read_volume(spark, str(file)), a.shape) == a).all()
    with pytest.raises(ValueError):
        codecs.Pages(None, (5000, 1000, 1000), "float32", ".tif")


def test_slices_keep_their_names(spark, tmp_path):
    a = np.random.default_rng(6).integers(0, 200, (3, 4, 5)).astype(float)
    names = spark.createDataFrame([(0, "first.tif"), (1, "b.png"), (2, "c.nii.gz")], "z long, name string")
    volumes.write_named(frame(spark, a), str(tmp_path), names, "uint8").count()
    for z, name in enumerate(("first.tif", "b.png", "c.nii.gz")):
        assert (array(volumes.read_volume(spark, str(tmp_path / name)), (1, 4, 5)) == a[z]).all()


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:0{i}", float(i)) for i in range(4)] + [("a", "2024-01-01 01:00:00", 9.0)]
    spark.createDataFrame(rows, "kind string, ts string, v double").selectExpr("kind", "CAST(ts AS TIMESTAMP) AS ts", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = slices.windowed_statistics(stream, "ts", "10 minutes", "1 hour", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.mean) for r in spark.table("windows").collect()) == [(1, 9.0), (4, 1.5)]


def test_codecs_refuse():
    with pytest.raises(ValueError):
        codecs.decode(b"", ".bmp")
    four = bytearray(codecs.write_nifti(np.zeros((2, 2, 2), "u1")))
    four[40:50] = np.array([4, 2, 2, 1, 2], "<i2").tobytes()
    with pytest.raises(ValueError):
        codecs.read_nifti(bytes(four))


def test_directory_of_slices(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 9, (5, 4, 6)).astype(float)
    folder = str(tmp_path / "stack")
    assert volumes.write_slices(frame(spark, a), folder, "s", ".png", "uint8").count() == 5
    assert (array(volumes.read_volume(spark, folder), a.shape) == a).all()
    (tmp_path / "stack" / "zz.png").write_bytes(codecs.write_png(np.zeros((2, 2), np.uint8)))
    with pytest.raises(ValueError):
        volumes.read_volume(spark, folder)


def test_stores_and_pyramids(spark, tmp_path):
    a = np.random.default_rng(3).normal(size=(6, 8, 5)).astype(np.float32).astype(float)
    to = str(tmp_path / "v.ome.zarr")
    volumes.write_ome_zarr(frame(spark, a), to, a.shape, (4, 4, 4), 2).count()
    assert (array(volumes.read_volume(spark, to), a.shape) == a).all()
    assert json.load(open(f"{to}/.zattrs"))["multiscales"][0]["datasets"][1]["path"] == "1"
    volumes.write_blocks(frame(spark, a), str(tmp_path / "blocks"), 4)
    part = volumes.read_blocks(spark, str(tmp_path / "blocks"), (1, 3), 4)
    assert part.count() == 2 * 40
    assert "PartitionFilters: [isnotnull(bz" in part._jdf.queryExecution().toString()


def test_conversion_task(spark, tmp_path):
    a = np.random.default_rng(4).normal(size=(4, 3, 5)).astype(np.float32).astype(float)
    source = tmp_path / "in.nii.gz"
    source.write_bytes(gzip.compress(codecs.write_nifti(a.astype("f4"))))
    done = convert.run(spark, {"inputs": [str(source)], "outputs": [str(tmp_path / "out")], "kinds": ["single-tif", "scroll-tif", "zarr"], "low": -0.5, "high": 0.5})
    assert sorted(done.values()) == [1, 1, 4]
    back = volumes.read_volume(spark, str(tmp_path / "out" / "volume.tif"))
    assert np.allclose(array(back, a.shape), np.clip(a, -0.5, 0.5))
    with pytest.raises(ValueError):
        convert.run(spark, {"inputs": [str(source)], "outputs": [str(tmp_path)], "kinds": ["single-tif"], "options": {"shape": (2, 3, 5)}})
    with pytest.raises(ValueError):
        convert.pairs(["a", "b"], ["c", "d", "e"])


def test_stream_into_blocks(spark, tmp_path):
    a = np.random.default_rng(5).normal(size=(6, 2, 2))
    frame(spark, a).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("z long, y long, x long, v double").parquet(str(tmp_path / "in"))
    slices.into_blocks(stream, str(tmp_path / "out"), str(tmp_path / "check"), 4).awaitTermination()
    assert (array(volumes.read_blocks(spark, str(tmp_path / "out")), a.shape) == a).all()


def test_guards():
    assert stats.fits_memory(1.0, 2.0) and not stats.fits_memory(1.1, 2.0) and stats.fits_memory(9, 1, zarr=True)
    assert stats.chunk_size(1 << 20, 1 << 30) == 102 and stats.chunk_size(1, 1 << 30) == 128
    assert ".nii.gz" in paths.SUFFIXES and callable(session)


def test_files_in_the_order_of_their_numbers(spark, tmp_path):
    """Chunks of different digits, and slices beyond five digits."""
    vox = spark.range(125).selectExpr("id AS z", "0L AS y", "0L AS x", "CAST(id AS DOUBLE) AS v")
    volumes.write_chunks(vox, str(tmp_path / "chunks"), 125, 10).count()
    assert all(r.z == r.v for r in volumes.read_volume(spark, str(tmp_path / "chunks")).collect())
    late = vox.where("z < 4").selectExpr("z + 99998 AS z", "y", "x", "v")
    volumes.write_slices(late, str(tmp_path / "slices")).count()
    assert all(r.z == r.v for r in volumes.read_volume(spark, str(tmp_path / "slices")).collect())


def _stack(spark, a, folder, name="s", suffix=".tif", dtype="float32"):
    volumes.write_slices(frame(spark, a), str(folder), name, suffix, dtype).count()


def test_configured_jobs(spark, tmp_path):
    """Preprocessing, inference, conversion and evaluation of folders, as a configuration describes them."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(5, 9, 8)).astype(np.float32).astype(float)
    for where in ("one", "deep/two"):
        _stack(spark, a, tmp_path / "in" / where / "images")
    config = {
        "normalization": {"z-score": {"std_multiplier": 2.0}},
        "outputs": {"zarr": {"chunk_size": [4, 4, 4]}},
        "inference": {"input_path": str(tmp_path / "in"), "output_path": str(tmp_path / "out"), "input_name": "images", "output_name": "images_net_mask", "preprocess": {"normalize_mode": "z-score", "pad_mode": "reflect", "low_cut": -1.5, "high_cut": 1.5},
                      "inference_patch_size": [3, 6, 6], "inference_overlay": [1, 2, 2], "batch_size": 2, "output": {"type": "Scroll-Tiff", "dtype": "uint16"}},
        "train": {"preprocess": {"normalize_mode": "min-max"}},
        "converter": [{"input_output": {str(tmp_path / "in" / "one" / "images"): str(tmp_path / "conv")}, "output": {"type": ["Zarr", "Single-Tiff"], "dtype": "float32"}}],
    }
    predict.save_checkpoint(spark, str(tmp_path / "net"), "linear", {"weight": 1.0, "bias": -0.1}, 1, 0.5)
    config["inference"]["model_path"] = str(tmp_path / "net")
    done = jobs.inference(spark, config)
    assert done == {str(tmp_path / "out" / "one"): 5, str(tmp_path / "out" / "deep" / "two"): 5}
    c = np.clip(a, -1.5, 1.5)
    wanted = np.where((c - c.mean()) / (c.std() * 2 + 1e-8) > 0.1, 65535, 0)
    (made,) = (tmp_path / "out" / "one").iterdir()
    assert made.name == "images_net_mask.scroll-tiff" and (array(volumes.read_volume(spark, str(made)), a.shape) == wanted).all()

    assert jobs.preprocess(spark, config, str(tmp_path / "in" / "one" / "images"), str(tmp_path / "pre")) == 5
    assert sorted(p.name for p in (tmp_path / "pre").iterdir()) == [f"s_{i:05d}.tif" for i in range(5)]
    assert np.allclose(array(volumes.read_volume(spark, str(tmp_path / "pre")), a.shape), (a - a.min()) / (a.max() - a.min() + 1e-8), atol=1e-6)

    assert set(jobs.conversion(spark, config)) == {f"{tmp_path / 'conv'}:Zarr", f"{tmp_path / 'conv'}:Single-Tiff"}
    for name in ("volume.zarr", "volume.tif"):
        assert (array(volumes.read_volume(spark, str(tmp_path / "conv" / name)), a.shape) == a).all()


def test_evaluation_of_folders(spark, tmp_path):
    rng = np.random.default_rng(8)
    g, p = (rng.random((4, 7, 6)) < 0.4) * 255.0, (rng.random((4, 7, 6)) < 0.4) * 255.0
    top = tmp_path / "brain"
    _stack(spark, g, top / "img_mask", "s", ".tif", "uint8")
    _stack(spark, p, top / "img_net_mask.scroll-tif", "s", ".tiff", "uint8")
    _stack(spark, p[:3], top / "img_other_mask.scroll-tiff", "s", ".tif", "uint8")
    (top / "img_other_mask.scroll-tiff" / "s_00001.tif").write_bytes(codecs.write_tiff(np.ones((3, 6), "u1")))  # of another height
    got = {r.model_name: r for r in jobs.evaluated(spark, str(tmp_path)).collect()}
    assert set(got) == {"net", "other"} and got["net"].parent_folder == "brain" and got["net"].image_folder == "img"
    for model, used in (("net", [0, 1, 2, 3]), ("other", [0, 2])):
        r = got[model]
        assert (r.files_evaluated, r.pixels_total) == (len(used), 42 * len(used))
        assert r.tp == ((g[used] > 0) & (p[used] > 0)).sum() and r.fn == ((g[used] > 0) & (p[used] == 0)).sum()
    jobs.analysis(spark, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "evaluation_report" / "detailed")).columns == ["parent_folder", "image_folder", "model_name", *report.DETAILED_COLUMNS]


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 50, (2, 2, 3, 4)).astype(float)
    rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, "sample long, panel int, y long, x long, v double")
    assert pictures.write_samples(df, str(tmp_path / "s")).count() == 2
    got = codecs.read_png((tmp_path / "s" / "sample_1.png").read_bytes())[0]
    grey = [np.round((x - x.min()) / (x.max() - x.min()) * 255) for x in a[1]]
    assert (got[:, :4] == grey[0]).all() and (got[:, 6:] == grey[1]).all() and (got[:, 4:6] == 255).all()
    curve = spark.createDataFrame([(e, m, float(e if m == "up" else 1)) for e in range(5) for m in ("up", "flat")] + [(9, "up", float("nan"))], "epoch long, metric string, value double")
    assert pictures.write_curves(curve, str(tmp_path / "c"), 20, 30).count() == 2
    up = codecs.read_png((tmp_path / "c" / "up.png").read_bytes())[0]
    assert up[19, 0] == 0 and up[0, 29] == 0 and up[0, 0] == 255 and (up == 0).any(axis=0).all()


def test_nifti_of_many_slices():
    """An axis beyond 16 bits: a header of NIfTI-2; shorter volumes keep that of NIfTI-1."""
    for depth, start in ((32767, 352), (32768, 544), (51282, 544)):
        a = np.arange(depth * 2, dtype="f4").reshape(depth, 1, 2)
        data = codecs.write_nifti(a)
        assert len(data) == start + a.nbytes and codecs._nifti_head(data[:352])[2:4] == (a.shape, start)
        assert (codecs.read_nifti(data) == a).all() and (codecs.read_nifti(codecs.write_nifti(a, True)) == a).all()
