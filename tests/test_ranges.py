"""The data source of byte ranges: like the decoders, few bytes for headers, boxes, files of many tasks, large ones."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from tessavox.sources import codecs, ranges, volumes


def bytes_of(path):
    return ranges.Bytes(fs.LocalFileSystem().open_input_file(path))


def stack(df):
    rows = df.orderBy("z").collect()
    return np.stack([np.array(r.data).reshape(r.height, r.width) for r in rows]), [r.z for r in rows]


def tiff(pages, strip, packed, big):
    """Pages (all of one type) in strips, classic or of 8-byte places, deflated or not, directories behind the values."""
    wide, code = ("Q", "<HHQQ") if big else ("I", "<HHII")
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
    link = len(out) - struct.calcsize(wide)
    for page in pages:
        strips = [page[i : i + strip].tobytes() for i in range(0, len(page), strip)]
        strips = [zlib.compress(s) if packed else s for s in strips]
        places = []
        for s in strips:
            places.append(len(out))
            out += s
        lists = []
        for values in (places, [len(s) for s in strips]):
            lists.append(len(out) if len(values) > 1 else values[0])
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}{wide}", *values)
        kind = 16 if big else 4
        tags = [(256, 3, 1, page.shape[1]), (257, 3, 1, page.shape[0]), (258, 3, 1, 8 * page.itemsize), (259, 3, 1, 8 if packed else 1), (273, kind, len(strips), lists[0]), (277, 3, 1, 1), (278, 3, 1, strip), (279, kind, len(strips), lists[1]), (339, 3, 1, {"u": 1, "i": 2, "f": 3}[page.dtype.kind])]
        struct.pack_into("<" + wide, out, link, len(out))
        out += struct.pack("<Q" if big else "<H", len(tags)) + b"".join(struct.pack(code, *t) for t in tags)
        link = len(out)
        out += struct.pack("<" + wide, 0)
    return bytes(out)


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("big", [False, True])
def test_strips_pages_and_boxes(spark, tmp_path, packed, big):
    a = np.random.default_rng(1).integers(0, 60000, (7, 23, 11)).astype("uint16")
    path = str(tmp_path / "v.tif")
    (tmp_path / "v.tif").write_bytes(tiff(a, 4, packed, big))
    read = ranges.registered(spark).read.format("volume_files")
    got, z = stack(read.option("bytes", 100).load(path))
    assert (got == a).all() and z == list(range(7))
    got, z = stack(read.options(z="2:5", y="3:14", x="2:9").load(path))
    assert (got == a[2:5, 3:14, 2:9]).all() and z == [2, 3, 4]
    if not packed:
        f, b = ranges.layout(path), bytes_of(path)
        reader = ranges.SliceReader({"path": path, "y": "3:5"})
        list(reader._ranges(ranges.Run(path, f, 0, 2, 3), b))
        assert b.read == 2 * 11 * 2


@pytest.mark.parametrize("suffix", [".tif", ".nii", ".nii.gz"])
def test_like_the_decoders(spark, tmp_path, suffix):
    a = np.random.default_rng(2).normal(size=(6, 9, 13)).astype("float32")
    path = str(tmp_path / f"v{suffix}")
    (tmp_path / f"v{suffix}").write_bytes(codecs.encode(a, suffix))
    got, _ = stack(volumes.read_slices(spark, path))
    assert (got == a).all()
    vox = volumes.read_volume(spark, path, z=(1, 4), y=(2, 20), x=(-3, 5))
    assert vox.count() == 3 * 7 * 5
    assert {(r.z, r.y, r.x): r.v for r in vox.collect()} == {(z, y, x): a[z, y, x] for z in range(1, 4) for y in range(2, 9) for x in range(5)}
    assert volumes.headers(spark, path).collect() == [(path, 6, 9, 13, "float32")]
    assert volumes.read_slices(spark, path, z=(6, 9)).count() == 0


def test_a_folder_is_one_volume(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 255, (5, 4, 6)).astype("uint8")
    for i, part in enumerate(np.split(a[:4], 2)):
        (tmp_path / f"v_{i}.tif").write_bytes(codecs.encode(part, ".tif"))
    (tmp_path / "v_2.png").write_bytes(codecs.encode(a[4:], ".png"))
    (tmp_path / "notes.txt").write_text("no volume")
    got, _ = stack(volumes.read_slices(spark, str(tmp_path)))
    assert (got == a).all()
    assert volumes.shape_of(spark, str(tmp_path)) == (5, 4, 6)
    (tmp_path / "v_3.tif").write_bytes(codecs.encode(a[:1, :3], ".tif"))
    with pytest.raises(Exception, match="must agree"):
        volumes.read_slices(spark, str(tmp_path)).count()
    assert volumes.read_slices(spark, str(tmp_path), checked=False).count() == 6


def test_headers_cost_few_bytes(tmp_path):
    a = np.zeros((40, 200, 300), "uint16")
    for suffix, most in ((".nii", 2048), (".tif", 41 * 1100), (".nii.gz", 4096)):
        (tmp_path / f"v{suffix}").write_bytes(codecs.encode(a, suffix))
        b = bytes_of(str(tmp_path / f"v{suffix}"))
        f = ranges.layout(str(tmp_path / f"v{suffix}"), b)
        assert (f.depth, f.height, f.width, f.shown) == (40, 200, 300, "uint16") and b.read <= most


def test_more_than_two_gigabytes_in_one_file(spark, tmp_path):
    """A sparse NIfTI file: many tasks, slices beyond 2 GB read on their own, headers without the values."""
    shape = (800, 1800, 2000)
    path = str(tmp_path / "large.nii")
    head = codecs._nifti_first(shape, np.dtype("uint8"))
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(352 + int(np.prod(shape)))
        f.seek(352 + 790 * 1800 * 2000)
        f.write(bytes(range(200)))
    assert os.path.getsize(path) > 2_800_000_000
    df = ranges.registered(spark).read.format("volume_files").load(path)
    assert len(ranges.SliceReader({"path": path}).partitions()) == 43
    some = df.where("z >= 790 AND z < 792").select("z", F.expr("aggregate(data, 0D, (a, v) -> a + v)").alias("s")).collect()
    assert sorted(map(tuple, some)) == [(790, sum(range(200))), (791, 0.0)]
    assert volumes.shape_of(spark, path) == shape


def test_filters_prune_partitions(tmp_path):
    path = str(tmp_path / "v.nii")
    (tmp_path / "v.nii").write_bytes(codecs.encode(np.zeros((20, 5, 5), "uint8"), ".nii"))

    def runs(*filters):
        reader = ranges.SliceReader({"path": path, "bytes": "75"})
        left = list(reader.pushFilters(list(filters)))
        return [(r.first, r.last) for p in reader.partitions() for r in p.runs], left

    assert runs()[0] == [(i, min(20, i + 3)) for i in range(0, 20, 3)]
    z = ("z",)
    assert runs(GreaterThanOrEqual(z, 4), LessThan(z, 7)) == ([(4, 7)], [])
    assert runs(GreaterThan(z, 4), LessThanOrEqual(z, 6)) == ([(5, 7)], [])
    assert runs(EqualTo(z, 19)) == ([(19, 20)], []) and runs(EqualTo(z, 20)) == ([], [])
    other = EqualTo(("height",), 5)
    assert runs(other, EqualTo(z, 0)) == ([(0, 1)], [other])


def test_sessions_with_and_without_pushed_filters(spark, tmp_path):
    """A session of default settings reads the same rows; it refuses readers that take filters."""
    a = np.arange(12 * 3 * 4, dtype="uint16").reshape(12, 3, 4)
    path, key = str(tmp_path / "v.nii"), "spark.sql.python.filterPushdown.enabled"
    (tmp_path / "v.nii").write_bytes(codecs.encode(a, ".nii"))
    plain = spark.newSession()
    plain.conf.set(key, "false")
    for s in (plain, spark):
        got = s.conf.get(key), sorted((r.z, r.data) for r in ranges.files(s).load(path).where("z >= 4 AND z < 7").collect())
        assert got == ("false" if s is plain else "true", [(z, a[z].astype(float).ravel().tolist()) for z in range(4, 7)])
        assert sorted(r.v for r in volumes.read_volume(s, path, z=(4, 6), y=(1, 2)).collect()) == sorted(a[4:6, 1].ravel().tolist())
    plain.conf.set(key, "true")
    assert ranges.files(plain).load(path).where("z = 11").count() == 1


def test_names_in_order():
    names = ["a/v_00002.tif", "a/v_00010.tif", "a/v_100000.tif", "a/v_z0-9.tif", "a/v_z10-19.tif", "a/v_z100-109.tif"]
    assert sorted(names, key=ranges.place)[:3] == names[:3]
    assert [n for n in sorted(names, key=ranges.place) if "_z" in n] == names[3:]
    assert ranges.reachable("/a/b") and ranges.reachable("file:///a") and not ranges.reachable("viewfs://x/a")


def _flat(spark, path, **box):
    return sorted((r.z, tuple(r.data)) for r in volumes.read_slices(spark, path, **box).collect())


def test_large_folders_are_planned_by_tasks(spark, tmp_path, monkeypatch):
    """No list of files on the driver: neither Spark's own nor the plan's, whatever the files hold."""
    a = np.random.default_rng(6).integers(0, 60000, (60, 3, 4)).astype("uint16")
    z = 0
    for i, n in enumerate([1] * 9 + [20] + [1] * 3 + [26, 2]):  # numbers beyond their digits
        suffix = (".tif", ".nii", ".nii.gz")[i % 3]
        (tmp_path / f"v_{99990 + i:05d}{suffix}").write_bytes(codecs.encode(a[z : z + n], suffix))
        z += n
    (tmp_path / "notes.txt").write_text("no volume")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "v.tif").write_bytes(b"")

    def refused(self):
        raise AssertionError("files listed on the driver")

    monkeypatch.setattr(type(spark.range(1)), "inputFiles", refused)
    wanted = [(k, tuple(p.ravel().astype(float))) for k, p in enumerate(a)]
    assert _flat(spark, str(tmp_path)) == wanted
    monkeypatch.setattr(ranges, "PLANNED", 4)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert _flat(spark, path) == wanted
    assert _flat(spark, str(tmp_path), z=(7, 31)) == wanted[7:31]
    assert [r.data[0] for r in volumes.read_slices(spark, str(tmp_path), z=(8, 12), y=(1, 2), x=(2, 3)).sort("z").collect()] == a[8:12, 1, 2].tolist()
    assert _flat(spark, str(tmp_path), z=(60, 90)) == []
    found = volumes.read_slices(spark, str(tmp_path)).where("z >= 28 AND z < 31").collect()
    assert sorted((r.z, tuple(r.data)) for r in found) == wanted[28:31]
    index, places = ranges.indexed(spark, str(tmp_path), 15)
    assert index.count() == 15 and len(ranges.SliceReader({"path": str(tmp_path), "places": places}).partitions()) <= 4
    pieces = ranges.SliceReader({"path": str(tmp_path), "places": places, "bytes": "240"}).partitions()
    assert len(pieces) > 4 and [(p.lo, q.lo) for p, q in zip(pieces, pieces[1:]) if p.hi != q.lo] == [] and pieces[-1].hi == 60
    (tmp_path / "w.tif").write_bytes(codecs.encode(a[:1, :2], ".tif"))
    with pytest.raises(ValueError, match="must agree"):
        volumes.read_slices(spark, str(tmp_path))
    assert volumes.read_slices(spark, str(tmp_path), checked=False).count() == 61


def test_folders_are_listed_by_a_task(spark, tmp_path, monkeypatch):
    """Folders of a root, hidden ones and odd names too; the driver never meets the files between them."""
    from tessavox.plans import jobs

    for where in ("a/images", "a b/x%20y", "_c/.d"):
        (tmp_path / where).mkdir(parents=True)
        for i in range(50):
            (tmp_path / where / f"{i}.tif").write_bytes(b"")
    asked, gateway = [], spark.sparkContext._gateway._gateway_client
    send = gateway.send_command
    monkeypatch.setattr(gateway, "send_command", lambda *a, **k: asked.append(1) or send(*a, **k))
    got = [r.path for r in jobs.directories(spark, str(tmp_path)).collect()]
    assert got == sorted(f"file:{tmp_path}{w}" for w in ("", "/a", "/a/images", "/a b", "/a b/x%20y", "/_c", "/_c/.d"))
    before = len(asked)
    for i in range(50, 1000):
        (tmp_path / "a" / "images" / f"{i}.tif").write_bytes(b"")
    jobs.directories(spark, str(tmp_path))
    assert len(asked) - before < 950


def test_tiles_over_a_range():
    from tessavox.operators import predict, tiling

    for full, size, overlap in ((40, 7, 3), (5, 9, 2), (9, 3, 0)):
        places = tiling.starts(full, size, overlap)
        for lo in range(full):
            for hi in range(lo + 1, full + 1):
                assert predict._over(places, size, lo, hi) == [s for s in places if s < hi and s + size > lo]
