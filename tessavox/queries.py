"""One query for each operator over the driver's tables, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavox.functions import flops, intensity, losses, paths
from tessavox.operators import augment, history, lineage, metrics, normalize, objects, pad, predict, report, resample, stats, stitch, tiling, train
from tessavox.plans import jobs
from tessavox.plans.views import table, truth_and_prediction, volume
from tessavox.sources import convert, volumes
from tessavox.streaming import slices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VOX = """vox AS (SELECT vec_id AS z, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
dim AS (SELECT max(z) + 1 AS depth FROM vox)"""
PAIR = (
    VOX
    + """,
sc AS (SELECT z, y, x, v, 1 / (1 + exp(-4 * (v + coalesce(lead(v) OVER (PARTITION BY z, y ORDER BY x), v)) / 2)) AS score FROM vox),
tp AS (SELECT z, y, x, CAST(v > 0.1 AS INT) AS gt, CAST(score > 0.58 AS INT) AS pr, score FROM sc)"""
)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def depth(spark: SparkSession, sf_dir: str) -> int:
    return int(table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0] or 0)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- statistics


@query(f"WITH {VOX} SELECT count(v) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM vox")
def vol_stats(spark, sf_dir):
    return _round(stats.statistics(volume(spark, sf_dir)), "mean", "std", "min", "max")


@query(f"WITH {VOX} SELECT z, count(v) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM vox GROUP BY z")
def slice_stats(spark, sf_dir):
    return _round(stats.statistics(volume(spark, sf_dir), "z"), "mean", "std", "min", "max")


@query(f"""WITH {VOX} SELECT max(z) + 1 AS depth, max(y) + 1 AS height, max(x) + 1 AS width, 'float32' AS dtype,
  round((max(z) + 1) * (max(y) + 1) * (max(x) + 1) * 4 / 1073741824.0, 9) AS size_gb, round(avg(v), 6) + 0.0 AS mean,
  round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM vox""")
def vol_metadata(spark, sf_dir):
    return _round(stats.metadata(volume(spark, sf_dir)), "mean", "std", "min", "max").withColumn("size_gb", F.round("size_gb", 9))


@query(f"WITH {VOX}, f AS (SELECT z // 50 AS file, max(y) + 1 AS h, max(x) + 1 AS w FROM vox GROUP BY 1) SELECT count(*) AS n_files, count(DISTINCT (h, w)) AS n_shapes, count(DISTINCT (h, w)) <= 1 AS consistent FROM f")
def volume_consistency(spark, sf_dir):
    return stats.consistency(volume(spark, sf_dir), F.expr("z DIV 50"))


HIST = """b AS (SELECT CAST(CASE WHEN v >= -0.4 AND v < 0.4 THEN least(floor((v + 0.4) * 64 / 0.8), 63) WHEN v = 0.4 THEN 63 END AS INT) AS bin FROM vox),
h AS (SELECT CAST(i AS INT) AS bin, count(b.bin) AS n FROM range(0, 64) t(i) LEFT JOIN b ON b.bin = i GROUP BY i)"""


@query(f"WITH {VOX}, {HIST} SELECT bin, n FROM h")
def vol_hist(spark, sf_dir):
    return stats.histogram(volume(spark, sf_dir), -0.4, 0.4, 64)


@query(f"WITH {VOX}, {HIST} SELECT bin, round(sum(n) OVER (ORDER BY bin) / (SELECT sum(n) FROM h), 6) + 0.0 AS cdf FROM h")
def vol_cdf(spark, sf_dir):
    return _round(stats.cdf(stats.histogram(volume(spark, sf_dir), -0.4, 0.4, 64), 64), "cdf")


@query(f"WITH {VOX} SELECT count(v) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM vox WHERE (z // 16) % 4 = 0")
def sampled_stats(spark, sf_dir):
    return _round(stats.statistics(stats.sampled(volume(spark, sf_dir), 0.25, 16)), "mean", "std", "min", "max")


@query("SELECT l_linenumber AS z, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def sparse_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("z"), F.col("l_extendedprice").alias("v"))
    return stats.statistics(rows, "z").withColumns({c: F.round(c, 4) for c in ("mean", "std")})


# --- normalisation and scalar maps

_ST = f"{VOX}, st AS (SELECT avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi FROM vox)"


def _by_slice(vox: DataFrame) -> DataFrame:
    """A normalised volume, summed up by slice."""
    return vox.groupBy("z").agg(r6(F.avg("v")).alias("mean"), r6(F.min("v")).alias("min"), r6(F.max("v")).alias("max"))


def _sql_by_slice(expression: str, more: str = "") -> str:
    return f"WITH {_ST}{more} SELECT z, round(avg(w), 6) + 0.0 AS mean, round(min(w), 6) + 0.0 AS min, round(max(w), 6) + 0.0 AS max FROM (SELECT z, {expression} AS w FROM vox, st) GROUP BY z"


@query(_sql_by_slice("(v - m) / (s + 1e-8)"))
def norm_zscore(spark, sf_dir):
    return _by_slice(normalize.normalized(volume(spark, sf_dir), "z-score"))


@query(_sql_by_slice("(v - m) / (s * 2 + 1e-8)"))
def norm_zscore_wide(spark, sf_dir):
    return _by_slice(normalize.from_config(volume(spark, sf_dir), {"z-score": {"multiplier": 1.0}}, "z-score", {"multiplier": 2.0}))


@query(_sql_by_slice("(v - lo) / (hi - lo + 1e-8)"))
def norm_minmax(spark, sf_dir):
    return _by_slice(normalize.normalized(volume(spark, sf_dir), "min-max"))


@query(_sql_by_slice("pow(greatest(0, least(1, (v - lo) / (hi - lo + 1e-8))), 1 / (1.8 + 1e-8))"))
def norm_gamma(spark, sf_dir):
    return _by_slice(normalize.normalized(volume(spark, sf_dir), "min-max-gamma", gamma=1.8))


@query(_sql_by_slice(
    """CASE WHEN v <= lo THEN c[1] WHEN v >= hi THEN c[64] ELSE
  (1 - ((v - lo) / ((hi - lo) / 63 + 1e-12) - floor((v - lo) / ((hi - lo) / 63 + 1e-12)))) * c[CAST(floor((v - lo) / ((hi - lo) / 63 + 1e-12)) AS INT) + 1]
  + ((v - lo) / ((hi - lo) / 63 + 1e-12) - floor((v - lo) / ((hi - lo) / 63 + 1e-12))) * coalesce(c[CAST(floor((v - lo) / ((hi - lo) / 63 + 1e-12)) AS INT) + 2], 1) END""",
    f", {HIST}, cd AS (SELECT bin, sum(n) OVER (ORDER BY bin) / (SELECT sum(n) FROM h) AS c FROM h), arr AS (SELECT list(c ORDER BY bin) AS c FROM cd)").replace("FROM vox, st)", "FROM vox, st, arr)"))
def norm_histeq(spark, sf_dir):
    return _by_slice(normalize.normalized(volume(spark, sf_dir), "histogram", bins=64, range_=(-0.4, 0.4)))


@query(f"""WITH {_ST} SELECT 'z-score' AS method, round((0 - m) / (s + 1e-8), 6) + 0.0 AS background FROM st
UNION ALL SELECT 'min-max', round(greatest(0, least(1, (0 - lo) / (hi - lo + 1e-8))), 6) + 0.0 FROM st
UNION ALL SELECT 'min-max-gamma', round(pow(greatest(0, least(1, (0 - lo) / (hi - lo + 1e-8))), 1 / (1.8 + 1e-8)), 6) + 0.0 FROM st""")
def background_values(spark, sf_dir):
    return _round(normalize.backgrounds(volume(spark, sf_dir), 1.8), "background")


@query(f"WITH {VOX}, c AS (SELECT CASE WHEN v < -0.1 THEN -0.1 WHEN v > 0.15 THEN 0.15 ELSE v END AS v FROM vox) SELECT count(v) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM c")
def clip_stats(spark, sf_dir):
    vox = volume(spark, sf_dir).withColumn("v", intensity.clip(F.col("v"), -0.1, 0.15))
    return _round(stats.statistics(vox), "mean", "std", "min", "max")


@query(f"""WITH {VOX} SELECT z, CAST(sum(CASE WHEN v > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_binary, CAST(sum(CASE WHEN v * 4 > -ln(1 / 0.6 - 1) THEN 65535 ELSE 0 END) AS BIGINT) AS sum_mask,
  CAST(sum(trunc(v * 100)) AS BIGINT) AS sum_cut, round(sum(1 / (1 + exp(-v))), 6) + 0.0 AS sum_sigmoid FROM vox GROUP BY z""")
def scalar_maps(spark, sf_dir):
    v = F.col("v")
    return volume(spark, sf_dir).groupBy("z").agg(
        F.sum(intensity.binary(v, 0.05)).alias("n_binary"),
        F.sum(intensity.to_mask(v * 4, intensity.logit_threshold(0.6), "uint16")).alias("sum_mask"),
        F.sum(intensity.truncated(v * 100)).alias("sum_cut"),
        r6(F.sum(intensity.sigmoid(v))).alias("sum_sigmoid"),
    )


# --- scans, files, tiles


@query(f"WITH {VOX} SELECT z, y, x, round(v, 6) + 0.0 AS v FROM vox WHERE z >= 10 AND z < 40 AND y >= 0 AND y < 3 AND x >= 2 AND x < 9")
def box_scan(spark, sf_dir):
    return _round(tiling.box(volume(spark, sf_dir), (10, 40), (-2, 3), (2, 9)), "v")


_FILES = "f AS (SELECT p_brand AS file, CAST(count(*) AS BIGINT) AS dz FROM part GROUP BY 1), fr AS (SELECT file, CAST(sum(dz) OVER (ORDER BY file) - dz AS BIGINT) AS lo, CAST(sum(dz) OVER (ORDER BY file) AS BIGINT) AS hi FROM f)"


def _files(spark, sf_dir):
    return tiling.stitched_ranges(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("file")).agg(F.count("*").alias("dz")))


@query(f"WITH {_FILES} SELECT * FROM fr")
def stitched_files(spark, sf_dir):
    return _files(spark, sf_dir)


@query(f"WITH {_FILES}, q AS (SELECT s_suppkey AS query, (s_suppkey * 37) % 1500 AS lo, (s_suppkey * 37) % 1500 + s_suppkey % 90 AS hi FROM supplier) SELECT query, file, greatest(fr.lo, q.lo) - fr.lo AS z0, least(fr.hi, q.hi) - fr.lo AS z1 FROM fr JOIN q ON fr.lo < q.hi AND fr.hi > q.lo AND q.hi > q.lo")
def file_overlap(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), ((F.col("s_suppkey") * 37) % 1500).alias("lo"), ((F.col("s_suppkey") * 37) % 1500 + F.col("s_suppkey") % 90).alias("hi"))
    return tiling.overlapping_files(_files(spark, sf_dir), q, 64)


def _axis(full: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"SELECT DISTINCT CAST(least(i * {step}, greatest(0, {full} - {size})) AS BIGINT) AS s FROM range(0, CAST(greatest(0, ({full} - {size} + {step - 1}) // {step}) + 1 AS BIGINT)) t(i)"


@query(f"WITH {VOX}, a AS ({_axis('(SELECT depth FROM dim)', 64, 16)}) SELECT s AS start, CAST(coalesce(64 - (lead(s) OVER (ORDER BY s) - s), 0) AS BIGINT) AS overlap FROM a")
def z_plan(spark, sf_dir):
    return tiling.z_plan(spark, depth(spark, sf_dir), 64, 16)


SIZE, OVERLAP = (32, 5, 4), (8, 2, 1)
_TILES = f"az AS ({_axis('(SELECT depth FROM dim)', 32, 8)}), ay AS ({_axis('8', 5, 2)}), ax AS ({_axis('8', 4, 1)})"


@query(f"""WITH {VOX}, {_TILES} SELECT CAST(row_number() OVER (ORDER BY az.s, ay.s, ax.s) - 1 AS BIGINT) AS patch_id, az.s AS z0, ay.s AS y0, ax.s AS x0,
  least(az.s + 32, (SELECT depth FROM dim)) AS z1, least(ay.s + 5, 8) AS y1, least(ax.s + 4, 8) AS x1, az.s + 7 AS global_z FROM az, ay, ax""")
def patch_grid(spark, sf_dir):
    return tiling.patch_grid(spark, (depth(spark, sf_dir), 8, 8), SIZE, OVERLAP, 7)


def _tiles(spark, sf_dir):
    return tiling.extracted(volume(spark, sf_dir), (depth(spark, sf_dir), 8, 8), SIZE, OVERLAP)


_EXTRACT = f"{VOX}, {_TILES}, ex AS (SELECT az.s AS z0, ay.s AS y0, ax.s AS x0, z, y, x, v FROM vox JOIN az ON z >= az.s AND z < az.s + 32 JOIN ay ON y >= ay.s AND y < ay.s + 5 JOIN ax ON x >= ax.s AND x < ax.s + 4)"


@query(f"WITH {_EXTRACT} SELECT z0, y0, x0, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM ex GROUP BY 1, 2, 3")
def patch_extract(spark, sf_dir):
    return _tiles(spark, sf_dir).groupBy("z0", "y0", "x0").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"))


@query(f"WITH {_EXTRACT} SELECT z0, y0, x0, bool_or(v > 0.33) AS positive FROM ex GROUP BY 1, 2, 3")
def patch_positive(spark, sf_dir):
    return tiling.positive_patches(_tiles(spark, sf_dir), "v", 0.33)


@query(f"""WITH {_EXTRACT}, p AS (SELECT z0, y0, x0, bool_or(v > 0.33) AS positive, z0 * 64 + y0 * 8 + x0 AS patch_id FROM ex GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY (patch_id * 7919) % 1000003, patch_id) AS r, (SELECT count(*) FROM p WHERE positive) AS np FROM p)
SELECT z0, y0, x0, positive, patch_id FROM k WHERE positive OR r <= floor(np * 0.5)""")
def patch_sample(spark, sf_dir):
    patches = tiling.positive_patches(_tiles(spark, sf_dir), "v", 0.33).withColumn("patch_id", F.col("z0") * 64 + F.col("y0") * 8 + F.col("x0"))
    return tiling.sampled_patches(patches, 0.5)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY ((doc_id + 42) * 7919) % 1000003, doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r""")
def train_val_split(spark, sf_dir):
    return tiling.split(table(spark, sf_dir, "documents").select("doc_id"), 0.2, "doc_id", 42)


# --- padding

_PADDED = {
    "edge": "least(greatest({i}, 0), {n} - 1)",
    "reflect": "CASE WHEN (({i}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)) < {n} THEN (({i}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)) ELSE 2 * ({n} - 1) - (({i}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)) END",
    "symmetric": "CASE WHEN (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END",
}


def _sql_pad(mode: str) -> str:
    at = _PADDED.get(mode, "{i}")
    axes = ", ".join(f"p{c} AS (SELECT o AS o{c}, {at.format(i=f'o - {b}', n=n)} AS i{c} FROM range(0, CAST({t} AS BIGINT)) t(o))" for c, n, b, t in (("z", "(SELECT depth FROM dim)", 6, "(SELECT depth + 12 FROM dim)"), ("y", 8, 0, 12), ("x", 8, 0, 19)))
    join = "LEFT JOIN" if mode == "constant" else "JOIN"
    return f"WITH {VOX}, {axes} SELECT oz AS z, oy AS y, ox AS x, round(coalesce(v, -1.0), 6) + 0.0 AS v FROM pz CROSS JOIN py CROSS JOIN px {join} vox b ON b.z = iz AND b.y = iy AND b.x = ix"


def _padded(mode: str) -> Query:
    def run(spark, sf_dir):
        d = depth(spark, sf_dir)
        pads = (pad.widths(d, d + 12, True), pad.widths(8, 12, False), pad.widths(8, 19, False))
        return _round(pad.padded(volume(spark, sf_dir), (d, 8, 8), pads, mode, -1.0), "v")

    run.__name__ = f"pad_{mode}"
    return run


for _mode in pad.MODES:
    query(_sql_pad(_mode))(_padded(_mode))


@query(f"""WITH {VOX}, m AS (SELECT (32 - depth % 32) % 32 AS more, ((32 - depth % 32) % 32) // 2 AS front, depth FROM dim),
o AS (SELECT z, y, x FROM range(0, CAST((SELECT depth + more FROM m) AS BIGINT)) a(z), range(0, 32) b(y), range(0, 32) c(x))
SELECT o.z, o.y, o.x, round(coalesce(v, 0.25), 6) + 0.0 AS v FROM o CROSS JOIN m LEFT JOIN vox ON vox.z = o.z - m.front AND vox.y = o.y - 12 AND vox.x = o.x - 12""")
def pad_to_multiple(spark, sf_dir):
    d = depth(spark, sf_dir)
    return _round(pad.padded(volume(spark, sf_dir), (d, 8, 8), (pad.multiple_widths(d), pad.multiple_widths(8), pad.multiple_widths(8)), "constant", 0.25), "v")


# --- stitching and resampling


@query(f"WITH {_EXTRACT} SELECT z, y, x, round(avg(v + z0 * 0.001 + x0 * 0.01), 6) + 0.0 AS v FROM ex GROUP BY 1, 2, 3")
def stitch_mean(spark, sf_dir):
    tiles = _tiles(spark, sf_dir).withColumn("v", F.col("v") + F.col("z0") * 0.001 + F.col("x0") * 0.01)
    return _round(stitch.patch_means(tiles, (depth(spark, sf_dir), 8, 8)), "v")


_BLEND = f"""WITH {VOX}, a AS ({_axis('(SELECT depth FROM dim)', 64, 16)}), c AS (SELECT s, z, y, x, v + s * 0.001 AS v FROM vox JOIN a ON z >= s AND z < s + 64)
SELECT z, y, x, round(list_reduce(list(v ORDER BY s), lambda p, q: (p + q) / 2), 6) + 0.0 AS v FROM c GROUP BY 1, 2, 3"""


@query(_BLEND)
def streamed_blend(spark, sf_dir):
    """The chunks read as a stream; the result is what the stream has appended to its files."""
    d, at, to = depth(spark, sf_dir), _folder(spark, "chunks"), _folder(spark, "blend")
    chunks = stitch.chunked(volume(spark, sf_dir), d, 64, 16).withColumn("v", F.col("v") + F.col("z0") * 0.001)
    chunks.write.parquet(at)
    stream = slices.blended(spark.readStream.schema(chunks.schema).parquet(at), d, 64, band=2)
    stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return _round(spark.read.schema("z long, y long, x long, v double").parquet(to), "v")


@query(_BLEND)
def stitch_blend(spark, sf_dir):
    chunks = stitch.chunked(volume(spark, sf_dir), depth(spark, sf_dir), 64, 16).withColumn("v", F.col("v") + F.col("z0") * 0.001)
    return _round(stitch.blended(chunks), "v")


def _near(c: str, full: str, new: str) -> str:
    return f"n{c} AS (SELECT o AS o{c}, CAST(least({full} - 1, floor((o + 0.5) * {full} / {new})) AS BIGINT) AS i{c} FROM range(0, CAST({new} AS BIGINT)) t(o))"


_NEW = "(SELECT depth * 33 // 20 FROM dim)"


@query(f"WITH {VOX}, {_near('z', '(SELECT depth FROM dim)', _NEW)}, {_near('y', '8', '5')}, {_near('x', '8', '11')} SELECT oz AS z, oy AS y, ox AS x, round(v, 6) + 0.0 AS v FROM nz, ny, nx, vox WHERE z = iz AND y = iy AND x = ix")
def resize_nn(spark, sf_dir):
    d = depth(spark, sf_dir)
    return _round(resample.nearest(volume(spark, sf_dir), (d, 8, 8), (d * 33 // 20, 5, 11)), "v")


@query(f"""WITH {VOX},
t AS (SELECT o, greatest(0.0, least(7.0, (o + 0.5) * (8.0 / 13) - 0.5)) AS p FROM range(0, 13) t(o)),
w AS (SELECT o, i, greatest(0.0, 1 - abs(p - i)) AS w FROM t, range(0, 8) u(i) WHERE 1 - abs(p - i) > 0),
s AS (SELECT z, o AS y, x, sum(v * w) AS v FROM vox JOIN w ON y = i GROUP BY 1, 2, 3)
SELECT z, y, o AS x, round(sum(v * w), 6) + 0.0 AS v FROM s JOIN w ON x = i GROUP BY 1, 2, 3""")
def resize_linear(spark, sf_dir):
    d = depth(spark, sf_dir)
    return _round(resample.linear(volume(spark, sf_dir), (d, 8, 8), (d, 13, 13)), "v")


def _half(i: int) -> str:
    d = [f"(depth // {2 ** (i - 1)})", f"(depth // {2**i})"]
    s = 8 // 2 ** (i - 1)
    at = lambda o, a, b: f"CAST(least({a} - 1, floor(({o} + 0.5) * {a} / {b})) AS BIGINT)"
    return f"l{i} AS (SELECT oz AS z, oy AS y, ox AS x, v FROM l{i - 1}, dim, (SELECT unnest(range(0, (SELECT depth // {2**i} FROM dim))) AS oz) a, range(0, {s // 2}) b(oy), range(0, {s // 2}) c(ox) WHERE z = {at('oz', *d)} AND y = {at('oy', s, s // 2)} AND x = {at('ox', s, s // 2)})"


@query(f"WITH {VOX}, l0 AS (SELECT z, y, x, v FROM vox), {_half(1)}, {_half(2)} SELECT CAST(level AS INT) AS level, z, y, x, round(v, 6) + 0.0 AS v FROM (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2)")
def pyramid(spark, sf_dir):
    return _round(resample.pyramid(volume(spark, sf_dir), (depth(spark, sf_dir), 8, 8), 3), "v")


@query(f"WITH {VOX} SELECT printf('vol_y%05d', y) AS file, y AS slice, z AS row, x AS col, round(v, 6) + 0.0 AS v FROM vox")
def reslice(spark, sf_dir):
    return _round(resample.resliced(volume(spark, sf_dir), (depth(spark, sf_dir), 8, 8), 1, "vol"), "v")


@query(f"WITH {VOX} SELECT printf('vol_x%05d', 7 - x) AS file, 7 - x AS slice, z AS row, y AS col, round(v, 6) + 0.0 AS v FROM vox")
def reslice_reversed(spark, sf_dir):
    return _round(resample.resliced(volume(spark, sf_dir), (depth(spark, sf_dir), 8, 8), 5, "vol"), "v")


@query(f"""WITH {VOX}, l AS (SELECT i, CAST(2 ** i AS BIGINT) AS f FROM range(0, 5) t(i), dim WHERE least(depth, 8) // CAST(2 ** i AS BIGINT) >= 1)
SELECT '[{{"version": "0.4", "name": "image", "axes": [{{"name": "z", "type": "space"}}, {{"name": "y", "type": "space"}}, {{"name": "x", "type": "space"}}], "datasets": ['
  || string_agg('{{"path": "' || i || '", "coordinateTransformations": [{{"type": "scale", "scale": [' || f || ', ' || f || ', ' || f || ']}}]}}', ', ' ORDER BY i) || ']}}]' AS multiscales FROM l""")
def ome_metadata(spark, sf_dir):
    n = len(resample.levels((depth(spark, sf_dir), 8, 8), 5, 2))
    return spark.range(1).select(F.lit(resample.ome_metadata(n, 2)).alias("multiscales"))


# --- metrics and losses

_CM = """CAST(count(*) FILTER (gt = 1 AND pr = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (gt = 0 AND pr = 1) AS BIGINT) AS fp,
CAST(count(*) FILTER (gt = 1 AND pr = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (gt = 0 AND pr = 0) AS BIGINT) AS tn"""
_SCORES = """round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) + 0.0 AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision,
round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall,
round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 6) + 0.0 AS f1,
round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) + 0.0 AS iou, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS dice"""
_MCC = "coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"
_NAMES = ("accuracy", "precision", "recall", "f1", "iou", "dice", "mcc")


@query(f"WITH {PAIR}, c AS (SELECT z, {_CM} FROM tp GROUP BY z) SELECT z, tp, fp, fn, tn, {_SCORES}, round({_MCC}, 6) + 0.0 AS mcc FROM c")
def confusion(spark, sf_dir):
    return _round(metrics.scores(metrics.confusion(truth_and_prediction(spark, sf_dir), "z")), *_NAMES)


@query(f"""WITH b AS (SELECT d.lang, l.quality AS gt, CAST(d.n_chars > 1000 AS INT) AS pr FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT lang, {_CM} FROM b GROUP BY lang)
SELECT lang, tp, fp, fn, tn, {_SCORES}, round({_MCC}, 6) + 0.0 AS mcc FROM c""")
def label_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("CAST(n_chars > 1000 AS INT)").alias("pr"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gt")).join(docs, "doc_id")
    return _round(metrics.scores(metrics.confusion(rows, "lang")), *_NAMES)


@query(f"""WITH {PAIR}, s AS (SELECT z, (2 * sum(score * gt) + 1e-5) / (sum(score) + sum(gt) + 1e-5) AS dice,
  (2 * sum(CASE WHEN score > 0.5 AND gt = 1 THEN 1.0 ELSE 0 END) + 1e-5) / (sum(CASE WHEN score > 0.5 THEN 1.0 ELSE 0 END) + sum(gt) + 1e-5) AS hard_dice,
  (sum(CASE WHEN score > 0.5 AND gt = 1 THEN 1.0 ELSE 0 END) + 1e-5) / (sum(CASE WHEN score > 0.5 OR gt = 1 THEN 1.0 ELSE 0 END) + 1e-5) AS iou, avg(-(gt * ln(score) + (1 - gt) * ln(1 - score))) AS bce FROM tp GROUP BY z)
SELECT round(avg(dice), 6) AS dice, round(avg(hard_dice), 6) AS hard_dice, round(avg(iou), 6) AS iou, round(avg(bce), 6) AS bce FROM s""")
def soft_scores(spark, sf_dir):
    each = truth_and_prediction(spark, sf_dir).groupBy("z").agg(metrics.soft_dice().alias("dice"), metrics.hard_dice().alias("hard_dice"), metrics.iou().alias("iou"), F.avg(losses.cross_entropy(F.col("score"), F.col("gt"))).alias("bce"))
    return each.agg(*[F.round(F.avg(n), 6).alias(n) for n in ("dice", "hard_dice", "iou", "bce")])


@query(f"""WITH {PAIR}, a AS (SELECT sum(score * gt) AS b, sum(score) AS p, sum(gt) AS t, sum(score * (1 - gt)) AS fp, sum((1 - score) * gt) AS fn,
  avg(-(gt * ln(score) + (1 - gt) * ln(1 - score))) AS bce, avg(0.8 * pow(1 - exp(gt * ln(score) + (1 - gt) * ln(1 - score)), 2) * -(gt * ln(score) + (1 - gt) * ln(1 - score))) AS focal FROM tp),
l AS (SELECT 1 - (2 * b + 1e-6) / (p + t + 1e-6) AS dice, focal, 1 - (b + 1e-6) / (b + 0.3 * fp + 0.7 * fn + 1e-6) AS tversky, bce FROM a)
SELECT round(dice, 6) AS dice, round(focal, 6) AS focal, round(tversky, 6) AS tversky, round(ln((exp(dice) + exp(-dice)) / 2), 6) AS log_cosh_dice, round(bce, 6) AS bce, round(0.5 * dice + 2 * bce, 6) AS combined FROM l""")
def loss_values(spark, sf_dir):
    p, t = F.col("score"), F.col("gt")
    return truth_and_prediction(spark, sf_dir).agg(
        F.round(losses.dice_loss(p, t), 6).alias("dice"),
        F.round(losses.focal_loss(p, t), 6).alias("focal"),
        F.round(losses.tversky_loss(p, t, 0.3, 0.7), 6).alias("tversky"),
        F.round(losses.log_cosh_dice_loss(p, t), 6).alias("log_cosh_dice"),
        F.round(losses.LOSSES["bce"](p, t), 6).alias("bce"),
        F.round(losses.combined(p, t, {"dice": 0.5, "bce": 2.0}), 6).alias("combined"),
    )


_AUC = """pt AS (SELECT {g}, score, sum(gt) AS p, count(*) AS n FROM tp GROUP BY {g}, score),
cv AS (SELECT {g}, p, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM pt WINDOW w AS (PARTITION BY {g} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
auc AS (SELECT {g}, CASE WHEN sum(p) > 0 AND count(*) > 2 THEN sum(p * tp / al) / sum(p) ELSE 0 END AS pr_auc FROM cv GROUP BY {g})"""


@query(f"WITH {PAIR}, {_AUC.format(g='z')} SELECT z, round(pr_auc, 6) + 0.0 AS pr_auc FROM auc")
def pr_auc(spark, sf_dir):
    return _round(metrics.average_precision(truth_and_prediction(spark, sf_dir), "z"), "pr_auc")


_HD = """g AS (SELECT * FROM tp WHERE gt = 1), p AS (SELECT * FROM tp WHERE pr = 1),
d1 AS (SELECT p.z, sqrt(min((p.y - g.y) ** 2 + (p.x - g.x) ** 2)) AS d FROM p JOIN g ON p.z = g.z GROUP BY p.z, p.y, p.x),
d2 AS (SELECT g.z, sqrt(min((p.y - g.y) ** 2 + (p.x - g.x) ** 2)) AS d FROM g JOIN p ON p.z = g.z GROUP BY g.z, g.y, g.x),
hd AS (SELECT z, max(h) AS hausdorff FROM (SELECT z, quantile_cont(CAST(d AS DOUBLE), 0.95) AS h FROM d1 GROUP BY z UNION ALL SELECT z, quantile_cont(CAST(d AS DOUBLE), 0.95) FROM d2 GROUP BY z) GROUP BY z)"""


@query(f"WITH {PAIR}, {_HD} SELECT z, round(hausdorff, 6) + 0.0 AS hausdorff FROM hd")
def hausdorff(spark, sf_dir):
    return _round(metrics.hausdorff(truth_and_prediction(spark, sf_dir)), "hausdorff")


@query(f"WITH {PAIR}, {_HD} SELECT z, round(hausdorff, 6) + 0.0 AS hausdorff FROM hd")
def hausdorff_by_strips(spark, sf_dir):
    """No task holds a whole slice: strips of three columns, then of three rows."""
    return _round(metrics.hausdorff(truth_and_prediction(spark, sf_dir), tile=3), "hausdorff")


@query(f"WITH {PAIR}, {_HD}, al AS (SELECT z, hausdorff FROM (SELECT DISTINCT z FROM tp) LEFT JOIN hd USING (z)) SELECT round(coalesce(avg(hausdorff) FILTER (z % 3 <> 0), 0), 6) + 0.0 AS value FROM al")
def valid_mean(spark, sf_dir):
    """Mean over slices, of which every third is made NaN."""
    per = metrics.hausdorff(truth_and_prediction(spark, sf_dir)).withColumn("h", F.when(F.col("z") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("hausdorff")))
    return _round(metrics.mean_of_valid(per, "h"), "value")


def _reach(cells: str, near: str) -> str:
    """Cells a of a mask and all cells b of their object."""
    return f"reach(z, y, x, z2, y2, x2) AS (SELECT z, y, x, z, y, x FROM {cells} UNION SELECT r.z, r.y, r.x, c.z, c.y, c.x FROM reach r JOIN {cells} c ON {near} AND abs(c.y - r.y2) <= 1 AND abs(c.x - r.x2) <= 1)"


def _count_sql(mask: str) -> str:
    least = "SELECT z, y, x, min(y2 * 8 + x2) AS root FROM reach GROUP BY 1, 2, 3"
    return f"SELECT z, count(DISTINCT root) AS n FROM ({least}) GROUP BY z".replace("reach", f"reach_{mask}")


@query(f"""WITH RECURSIVE {PAIR}, g AS (SELECT z, y, x FROM tp WHERE gt = 1), p AS (SELECT z, y, x FROM tp WHERE pr = 1),
{_reach('g', 'c.z = r.z2').replace('reach', 'reach_g')}, {_reach('p', 'c.z = r.z2').replace('reach', 'reach_p')}
SELECT z, coalesce(a.n, 0) AS gt_count, coalesce(b.n, 0) AS pr_count FROM (SELECT DISTINCT z FROM tp) LEFT JOIN ({_count_sql('g')}) a USING (z) LEFT JOIN ({_count_sql('p')}) b USING (z)""")
def object_counts(spark, sf_dir):
    return objects.object_metrics(truth_and_prediction(spark, sf_dir)).select("z", "gt_count", "pr_count")


#: Sizes, overlaps and matches: with a least overlap of a half a prediction and a truth match if each is the other's first.
_MATCHES = f"""WITH RECURSIVE {PAIR}, g AS (SELECT z, y, x FROM tp WHERE gt = 1), p AS (SELECT z, y, x FROM tp WHERE pr = 1),
{_reach('g', 'c.z = r.z2').replace('reach', 'reach_g')}, {_reach('p', 'c.z = r.z2').replace('reach', 'reach_p')},
lg AS (SELECT z, y, x, min(y2 * 8 + x2) AS g FROM reach_g GROUP BY z, y, x), lp AS (SELECT z, y, x, min(y2 * 8 + x2) AS p FROM reach_p GROUP BY z, y, x),
sg AS (SELECT z, g, count(*) AS n_g FROM lg GROUP BY z, g), sp AS (SELECT z, p, count(*) AS n_p FROM lp GROUP BY z, p),
b AS (SELECT z, p, g, count(*) AS n FROM lp JOIN lg USING (z, y, x) GROUP BY z, p, g),
k AS (SELECT z, p, g FROM b JOIN sg USING (z, g) JOIN sp USING (z, p) WHERE n / (n_p + n_g - n) >= 0.5),
h AS (SELECT z, count(*) AS matched FROM (SELECT z, p = min(p) OVER (PARTITION BY z, g) AND g = min(g) OVER (PARTITION BY z, p) AS ok FROM k) WHERE ok GROUP BY z),
c AS (SELECT z, coalesce(a.n, 0) AS gt_count, coalesce(b.n, 0) AS pr_count, coalesce(matched, 0) AS matched FROM (SELECT DISTINCT z FROM tp)
  LEFT JOIN (SELECT z, count(*) AS n FROM sg GROUP BY z) a USING (z) LEFT JOIN (SELECT z, count(*) AS n FROM sp GROUP BY z) b USING (z) LEFT JOIN h USING (z))
SELECT z, gt_count, pr_count, matched, round(coalesce(matched / nullif(pr_count, 0), 0), 6) + 0.0 AS obj_precision, round(coalesce(matched / nullif(gt_count, 0), 0), 6) + 0.0 AS obj_recall,
  round(coalesce(2 * matched / nullif(gt_count + pr_count, 0), 0), 6) + 0.0 AS obj_f1 FROM c"""


@query(_MATCHES)
def object_matches(spark, sf_dir):
    return _round(objects.object_metrics(truth_and_prediction(spark, sf_dir)).drop("hausdorff", "cldice"), "obj_precision", "obj_recall", "obj_f1")


@query(_MATCHES)
def object_matches_in_tiles(spark, sf_dir):
    """The same from tiles of three by three pixels, whose objects meet at the borders."""
    return _round(objects.tiled_metrics(truth_and_prediction(spark, sf_dir), tile=3), "obj_precision", "obj_recall", "obj_f1")


def _thin_sql() -> str:
    """Two alternating passes over padded slices as lists of 100 cells, until two passes in a row change nothing."""
    around = ["i - 10", "i - 9", "i + 1", "i + 11", "i + 10", "i + 9", "i - 1", "i - 11"]
    p = [f"s[{a}]" for a in around]
    turns = " + ".join(f"(1 - {a}) * {b}" for a, b in zip(p, [*p[1:], p[0]], strict=True))
    n, e, south, w = p[0], p[2], p[4], p[6]
    side = f"CASE WHEN k % 2 = 0 THEN {n} * {e} * {south} + {e} * {south} * {w} ELSE {n} * {e} * {w} + {n} * {south} * {w} END = 0"
    drop = f"{' + '.join(p)} BETWEEN 2 AND 6 AND {turns} = 1 AND {side}"
    new = f"[CASE WHEN s[i] = 1 AND {drop} THEN 0 ELSE s[i] END for i in range(1, 101)]"
    return f"""mk AS (SELECT z, which, list(CAST(coalesce(on_, 0) AS INT) ORDER BY i) AS s FROM (SELECT DISTINCT z FROM tp) CROSS JOIN (SELECT unnest(['gt', 'pr']) AS which) CROSS JOIN range(1, 101) c(i)
  LEFT JOIN (SELECT z, unnest(['gt', 'pr']) AS which, (y + 1) * 10 + x + 2 AS i, unnest([gt, pr]) AS on_ FROM tp) USING (z, which, i) GROUP BY z, which),
th(z, which, k, quiet, s) AS (SELECT z, which, 0, 0, s FROM mk UNION ALL SELECT z, which, k + 1, CASE WHEN n = s THEN quiet + 1 ELSE 0 END, n FROM (SELECT *, {new} AS n FROM th WHERE quiet < 2)),
ln AS (SELECT z, which, arg_max(t.s, k) AS line, any_value(m.s) AS own FROM th t JOIN mk m USING (z, which) GROUP BY z, which),
ov AS (SELECT g.z, list_sum(g.own) AS ng, list_sum(p.own) AS np, list_sum(list_transform(range(1, 101), lambda i: g.line[i] * p.own[i])) / (list_sum(g.line) + 1e-6) AS a,
  list_sum(list_transform(range(1, 101), lambda i: p.line[i] * g.own[i])) / (list_sum(p.line) + 1e-6) AS b FROM ln g JOIN ln p ON g.z = p.z AND g.which = 'gt' AND p.which = 'pr'),
cl AS (SELECT z, CASE WHEN ng > 0 AND np > 0 AND a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END AS cldice FROM ov)"""


@query(f"WITH RECURSIVE {PAIR}, {_thin_sql()} SELECT z, round(cldice, 6) + 0.0 AS cldice FROM cl")
def centre_lines(spark, sf_dir):
    """How much the centre lines of truth and prediction lie in each other's masks, from tiles of five by five pixels."""
    return _round(objects.tiled_centre_dice(truth_and_prediction(spark, sf_dir), tile=5, halo=4), "cldice")


@query(_MATCHES.replace("c AS (SELECT z, coalesce", _thin_sql() + ",\nc AS (SELECT z, cldice, coalesce").replace("LEFT JOIN h USING (z))", "LEFT JOIN h USING (z) JOIN cl USING (z))").replace("AS obj_f1 FROM c", "AS obj_f1, round(cldice, 6) + 0.0 AS cldice FROM c"))
def object_scores(spark, sf_dir):
    return _round(objects.object_metrics(truth_and_prediction(spark, sf_dir)).drop("hausdorff"), "obj_precision", "obj_recall", "obj_f1", "cldice")


@query(f"""WITH RECURSIVE {VOX}, c AS (SELECT z, y, x FROM vox WHERE v > 0.2), {_reach('c', 'abs(c.z - r.z2) <= 1 AND c.z BETWEEN r.z2 - 1 AND r.z2 + 1')},
k AS (SELECT z, y, x, min((z2 * 1048576 + y2) * 1048576 + x2) AS component FROM reach GROUP BY 1, 2, 3)
SELECT component, count(*) AS n, min(z) AS z_min, max(z) AS z_max FROM k GROUP BY component""")
def volume_components(spark, sf_dir):
    return objects.components(volume(spark, sf_dir).where("v > 0.2")).groupBy("component").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


_SECOND = "SELECT z, y, x, v - 0.05 AS v FROM vox WHERE (z % 5 <> 0 OR x < 7) AND z % 7 <> 3"


@query(f"""WITH {VOX}, p AS ({_SECOND}), s AS (SELECT a.z FROM (SELECT z, max(y) AS h, max(x) AS w FROM vox GROUP BY z) a JOIN (SELECT z, max(y) AS h, max(x) AS w FROM p GROUP BY z) b USING (z, h, w)),
j AS (SELECT z, CAST(vox.v > 0 AS INT) AS gt, CAST(p.v > 0 AS INT) AS pr FROM vox JOIN p USING (z, y, x) WHERE z IN (SELECT z FROM s)), c AS (SELECT z, {_CM} FROM j GROUP BY z)
SELECT z, tp, fp, fn, tn, {_SCORES}, round({_MCC}, 6) + 0.0 AS mcc FROM c""")
def coordinate_join(spark, sf_dir):
    """Scores of a second volume against the first; slices of another width, or missing ones, don't count."""
    first = volume(spark, sf_dir)
    second = first.where("(z % 5 != 0 OR x < 7) AND z % 7 != 3").withColumn("v", F.col("v") - 0.05)
    return _round(metrics.scores(metrics.confusion(metrics.compared(first, second), "z")), *_NAMES)


@query(f"""WITH {PAIR.replace("CAST(score > 0.58 AS INT) AS pr", "CAST(score > 0.5 AS INT) AS pr")}, {_HD}, {_AUC.format(g='z')}, m AS (SELECT z, (2 * sum(score * gt) + 1e-5) / (sum(score) + sum(gt) + 1e-5) AS dice_soft,
  (2 * count(*) FILTER (pr = 1 AND gt = 1) + 0.1) / (count(*) FILTER (pr = 1) + sum(gt) + 0.1) AS dice_hard, (count(*) FILTER (pr = 1 AND gt = 1) + 1e-5) / (count(*) FILTER (pr = 1 OR gt = 1) + 1e-5) AS iou,
  avg(-(gt * ln(score) + (1 - gt) * ln(1 - score))) AS bce FROM tp GROUP BY z), k AS (SELECT z, {_MCC} AS mcc FROM (SELECT z, {_CM} FROM tp GROUP BY z)),
a AS (SELECT avg(dice_soft) AS dice_soft, avg(dice_hard) AS dice_hard, avg(iou) AS iou, avg(bce) AS bce, avg(mcc) AS mcc, coalesce(avg(hausdorff), 0) AS hausdorff, avg(pr_auc) AS pr_auc FROM m JOIN k USING (z) LEFT JOIN hd USING (z) LEFT JOIN auc USING (z))
SELECT metric, round(value, 6) + 0.0 AS value FROM a UNPIVOT (value FOR metric IN (dice_soft, dice_hard, iou, bce, mcc, hausdorff, pr_auc)) UNION ALL SELECT 'my_dice', round(dice_soft, 6) + 0.0 FROM a""")
def metric_registry(spark, sf_dir):
    names = ["dice_soft", "Dice_Hard", "iou", "bce", "mcc", "hausdorff", "pr_auc", "my_dice"]
    return _round(metrics.from_config(truth_and_prediction(spark, sf_dir), names, {"dice_hard": {"smooth": 0.1}, "hausdorff": {"hd_percentile": 95.0}}), "value")


_MODEL = "tq AS (SELECT *, z % 5 AS image, z % 3 AS model FROM tp)"
_DETAIL = f"""{PAIR}, {_HD}, {_AUC.format(g='z')}, ms AS (SELECT z, {_MCC} AS mcc FROM (SELECT z, {_CM} FROM tp GROUP BY z)),
k AS (SELECT ms.z, ms.z % 5 AS image, ms.z % 3 AS model, mcc, hausdorff, pr_auc FROM ms LEFT JOIN hd USING (z) LEFT JOIN auc USING (z)),
mn AS (SELECT image, model, count(*) AS files_evaluated, avg(mcc) AS mcc, coalesce(avg(hausdorff), 0) AS hausdorff, coalesce(avg(CASE WHEN pr_auc > 0 THEN pr_auc END), 0) AS pr_auc FROM k GROUP BY 1, 2),
cc AS (SELECT z % 5 AS image, z % 3 AS model, {_CM} FROM tp GROUP BY 1, 2),
dt AS (SELECT cc.*, {_SCORES.replace("round(", "(").replace(", 6) + 0.0", ")")}, files_evaluated, mcc, hausdorff, pr_auc FROM cc JOIN mn USING (image, model))"""


def _details(spark, sf_dir):
    rows = truth_and_prediction(spark, sf_dir).withColumns({"image": F.col("z") % 5, "model": F.col("z") % 3})
    return report.detailed(rows, "image", "model")


_ALL = ("accuracy", "precision", "recall", "f1", "iou", "dice", "mcc", "hausdorff", "pr_auc")


@query(f"WITH {_DETAIL} SELECT image, model, tp + fp + fn + tn AS pixels_total, tp, fp, fn, tn, files_evaluated, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in _ALL)} FROM dt")
def report_detailed(spark, sf_dir):
    """The columns that SQL can express."""
    return _round(_details(spark, sf_dir), *_ALL).drop("cldice", "obj_f1", "gt_count", "pr_count")


@query(f"WITH {_DETAIL} SELECT model, count(*) AS n, {', '.join(f'round(avg({n}), 6) + 0.0 AS {n}_mean, round(stddev_pop({n}), 6) + 0.0 AS {n}_std' for n in _ALL)} FROM dt GROUP BY model")
def report_summary(spark, sf_dir):
    out = report.summary(_details(spark, sf_dir), names=_ALL)
    return _round(out, *[f"{n}_{s}" for n in _ALL for s in ("mean", "std")])


_EXACT = SQL["object_scores"].replace("round(cldice, 6) + 0.0 AS cldice", "cldice").replace("round(coalesce(2 * matched / nullif(gt_count + pr_count, 0), 0), 6) + 0.0 AS obj_f1", "coalesce(2 * matched / nullif(gt_count + pr_count, 0), 0) AS obj_f1")


@query(f"""WITH {_DETAIL}, ob AS (SELECT z % 5 AS image, z % 3 AS model, avg(cldice) AS cldice, avg(obj_f1) AS obj_f1, CAST(sum(gt_count) AS BIGINT) AS gt_count, CAST(sum(pr_count) AS BIGINT) AS pr_count FROM ({_EXACT}) GROUP BY 1, 2)
SELECT image, model, files_evaluated, tp + fp + fn + tn AS pixels_total, tp, fp, fn, tn, gt_count, pr_count, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in ("accuracy", "precision", "recall", "f1", "mcc", "hausdorff", "cldice", "obj_f1", "pr_auc"))} FROM dt JOIN ob USING (image, model)""")
def report_full(spark, sf_dir):
    """All columns of the detailed report."""
    out = _details(spark, sf_dir).select("image", "model", *report.DETAILED_COLUMNS)
    return _round(out, "accuracy", "precision", "recall", "f1", "mcc", "hausdorff", "cldice", "obj_f1", "pr_auc")


# --- histories

_HIST = "e AS (SELECT CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS epoch, event_type AS metric, value, user_id FROM events), hs AS (SELECT epoch, metric, sum(value) / count(value) AS value FROM e GROUP BY 1, 2)"


def _history(spark, sf_dir, keep: str = "true"):
    rows = table(spark, sf_dir, "events").select(F.unix_date(F.to_date("ts")).cast("long").alias("epoch"), F.col("event_type").alias("metric"), "value").where(keep)
    return history.epoch_means(rows, "epoch", "metric")


@query(f"WITH {_HIST} SELECT epoch, metric, round(value, 6) + 0.0 AS value FROM hs")
def epoch_means(spark, sf_dir):
    return _round(_history(spark, sf_dir), "value")


@query(f"WITH {_HIST}, hk AS (SELECT * FROM hs WHERE epoch % 3 = 0), al AS (SELECT * FROM (SELECT DISTINCT epoch FROM hs), (SELECT DISTINCT metric FROM hk)) SELECT epoch, metric, round(last_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY epoch ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS value FROM al LEFT JOIN hk USING (epoch, metric)")
def carry_forward(spark, sf_dir):
    h = _history(spark, sf_dir)
    return _round(history.carried(history.every(h, 3), h.select("epoch")), "value")


@query(f"WITH {_HIST}, b AS (SELECT epoch, metric, value, min(value) OVER (PARTITION BY metric ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM hs) SELECT epoch, metric, round(value, 6) + 0.0 AS value, round(least(value, coalesce(w, value)), 6) + 0.0 AS best, w IS NULL OR value < w AS improved FROM b")
def best_checkpoint(spark, sf_dir):
    return _round(history.best_so_far(_history(spark, sf_dir)), "value", "best")


@query(f"WITH {PAIR}, s AS (SELECT z % 7 AS volume, z // 7 AS z, sum(gt) AS total FROM tp GROUP BY z), r AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY total DESC, z) AS r, max(z) OVER (PARTITION BY volume) + 1 AS d FROM s) SELECT volume, CASE WHEN total > 0 THEN z ELSE d // 2 END AS z, CAST(total AS BIGINT) AS total FROM r WHERE r = 1")
def best_slice(spark, sf_dir):
    rows = truth_and_prediction(spark, sf_dir).select((F.col("z") % 7).alias("volume"), F.expr("z DIV 7").alias("z"), "gt")
    return history.best_slice(rows, "gt", "volume")


_AHEAD = "least(1, 0.1 / (sqrt(gw * gw + gb * gb) + 1e-6))"
_MOVED = "{w} * (1 - 0.0005) - 0.05 * ({m} / (1 - pow(0.9, k + 2))) / (sqrt({s} / (1 - pow(0.999, k + 2))) + 1e-8)"
_BATCH = "avg(ln(1 + exp(w * v + b)) - m * (w * v + b)) AS loss, (2 * sum(m / (1 + exp(-w * v - b))) + 1e-5) / (sum(1 / (1 + exp(-w * v - b))) + sum(m) + 1e-5) AS dice"


@query(f"""WITH RECURSIVE {VOX}, ids AS (SELECT DISTINCT z, z % 5 = 0 AS val, CAST('0x' || substr(md5('0:' || z), 1, 7) AS BIGINT) % 4 AS shard FROM vox),
o AS (SELECT z, ep, val, (row_number() OVER (PARTITION BY ep, val, shard ORDER BY CASE WHEN val THEN md5('0:' || z) ELSE md5('0:' || ep || ':' || z) END, CAST(z AS VARCHAR)) - 1) // 32 AS step FROM ids, range(1, 4) t(ep)),
n AS (SELECT max(step) FILTER (NOT val) + 1 AS t FROM o), d AS (SELECT ep, val, (ep - 1) * CASE WHEN val THEN 0 ELSE t END + step AS place, v, CAST(v > 0.1 AS DOUBLE) AS m FROM o JOIN vox USING (z), n),
r(k, loss, dice, w, b, mw, mb, sw, sb) AS (SELECT CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT k + 1, loss, dice, {_MOVED.format(w='w', m='mw', s='sw')}, {_MOVED.format(w='b', m='mb', s='sb')}, mw, mb, sw, sb FROM (
    SELECT k, loss, dice, w, b, 0.9 * mw + 0.1 * gw * c AS mw, 0.9 * mb + 0.1 * gb * c AS mb, 0.999 * sw + 0.001 * pow(gw * c, 2) AS sw, 0.999 * sb + 0.001 * pow(gb * c, 2) AS sb FROM (
      SELECT *, {_AHEAD} AS c FROM (SELECT k, w, b, mw, mb, sw, sb, {_BATCH}, avg((1 / (1 + exp(-w * v - b)) - m) * v) AS gw, avg(1 / (1 + exp(-w * v - b)) - m) AS gb
        FROM r JOIN d ON NOT val AND place = k + 1 GROUP BY k, w, b, mw, mb, sw, sb)))),
e AS (SELECT k // t + 1 AS epoch, 'train' AS split, loss, dice FROM r, n WHERE k >= 0 UNION ALL SELECT d.ep, 'val', {_BATCH} FROM d, n, r WHERE val AND r.k = d.ep * t - 1 GROUP BY d.ep, place),
a AS (SELECT epoch, split, avg(loss) AS loss, avg(dice) AS dice_soft FROM e GROUP BY epoch, split)
SELECT CAST(epoch AS INT) AS epoch, split, metric, round(value, 6) + 0.0 AS value FROM a UNPIVOT (value FOR metric IN (loss, dice_soft))""")
def trained_history(spark, sf_dir):
    """Three epochs of training on all slices, in batches of 128 dealt to four tasks."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"), F.col("embedding").cast("array<double>").alias("image"))
    patches = rows.withColumn("mask", F.transform("image", lambda v: (v > 0.1).cast("double")))
    out = train.fit(patches, _folder(spark, "training"), (8, 8), "linear", epochs=3, batch=128, metrics=("dice_soft",), learning_rate=0.05, weight_decay=0.01, max_grad_norm=0.1)
    return _round(out, "value")


@query("WITH p AS (SELECT event_type AS kind, count(*) AS n, sum(value) AS seconds, CAST(sum(user_id) AS BIGINT) AS flops FROM events GROUP BY 1) SELECT kind, n, round(seconds, 4) AS seconds, flops, round(100 * seconds / sum(seconds) OVER (), 6) AS share FROM p")
def module_profile(spark, sf_dir):
    out = history.profile(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value", "user_id"), "kind", "value", "user_id")
    return out.withColumns({"seconds": F.round("seconds", 4), "share": F.round("share", 6)})


@query("""WITH k AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS s FROM part)
SELECT p_partkey, 2 * (s * 4 // 2) * 27 * (s * 1000) AS conv, 2 * s * (s * 100) AS linear, 4 * s * 1000 AS norm, s * 1000 AS activation, 8 * s * 1000 AS gelu, 2 * (4 * s * s * 96 + 8 * s * 96 * 96) AS attention FROM k""")
def layer_flops(spark, sf_dir):
    s = F.col("p_size").cast("long")
    lit = lambda n: F.lit(n).cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        flops.conv(s * 4, lit(2), lit(27), s * 1000).alias("conv"),
        flops.linear(s, s * 100).alias("linear"),
        flops.norm(s * 1000).alias("norm"),
        flops.activation(s * 1000).alias("activation"),
        flops.gelu(s * 1000).alias("gelu"),
        flops.attention(lit(2), s, lit(96)).alias("attention"),
    )


# --- paths

_PATHS = """pt AS (SELECT '/data/' || replace(p_brand, '#', '_') || '/' || p_type || '/vol.' || p_partkey || ['.TIF', '.tiff', '.nii.gz', '.nii', '.png', '.txt', '.zarr', ''][p_partkey % 8 + 1] AS path FROM part),
px AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN lower(path) LIKE '%.nii.gz' THEN '.nii.gz' ELSE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) END AS sx FROM pt),
ps AS (SELECT path, name, CASE WHEN sx IN ('.tif', '.tiff', '.nii', '.nii.gz', '.gz', '.png', '.jpg') THEN sx ELSE '' END AS suffix FROM px)"""


def _paths(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".TIF", ".tiff", ".nii.gz", ".nii", ".png", ".txt", ".zarr", "")])
    return table(spark, sf_dir, "part").select(F.concat(F.lit("/data/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/"), "p_type", F.lit("/vol."), F.col("p_partkey").cast("string"), F.get(ends, (F.col("p_partkey") % 8).cast("int"))).alias("path"))


@query(f"WITH {_PATHS} SELECT path, suffix, CASE WHEN suffix = '.nii.gz' THEN name[1:len(name) - 7] ELSE regexp_replace(name, '\\.[^.]*$', '') END AS name, contains(path, '.zarr') AS zarr FROM ps")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", paths.suffix(p).alias("suffix"), paths.volume_name(p).alias("name"), paths.is_zarr(p).alias("zarr"))


@query(f"""WITH {_PATHS}, k AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path, suffix FROM ps WHERE suffix <> ''),
f AS (SELECT dir, min_by(suffix, path) AS suffix FROM k GROUP BY dir) SELECT dir, suffix, path, CAST(row_number() OVER (PARTITION BY dir ORDER BY path) - 1 AS INT) AS idx FROM k JOIN f USING (dir, suffix)""")
def directory_scan(spark, sf_dir):
    return paths.stacks(_paths(spark, sf_dir))


_DIRS = "d AS (SELECT '/' || replace(p_brand, '#', '_') || '/' || p_size || '/' || ['raw', 'mask', 'img_mask', 'img_unet_mask.scroll-tif', 'img_vnet_mask.scroll-tiff', 'other'][p_partkey % 6 + 1] AS path FROM part GROUP BY 1)"


def _dirs(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("raw", "mask", "img_mask", "img_unet_mask.scroll-tif", "img_vnet_mask.scroll-tiff", "other")])
    path = F.concat(F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), F.get(ends, (F.col("p_partkey") % 6).cast("int")))
    return table(spark, sf_dir, "part").select(path.alias("path")).distinct()


@query(f"WITH {_DIRS} SELECT a.path[1:len(a.path) - 4] AS rel, a.path AS image, b.path AS mask FROM d a JOIN d b ON a.path LIKE '%/raw' AND b.path = a.path[1:len(a.path) - 4] || '/mask'")
def training_pairs(spark, sf_dir):
    return paths.training_pairs(_dirs(spark, sf_dir), "raw", "mask")


@query(f"WITH {_DIRS} SELECT path FROM d WHERE path LIKE '%/raw'")
def inference_directories(spark, sf_dir):
    return paths.named_directories(_dirs(spark, sf_dir), "raw")


@query(f"""WITH {_DIRS}, s AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name FROM d)
SELECT g.parent, 'img' AS image, regexp_extract(p.name, '^img_(.*)_mask\\.scroll-tiff?$', 1) AS model, g.path AS gt, p.path AS prediction FROM s g JOIN s p ON g.parent = p.parent AND g.name = 'img_mask' AND p.name LIKE 'img\\_%\\_mask.scroll-tif%' ESCAPE '\\'""")
def evaluation_pairs(spark, sf_dir):
    return paths.evaluations(_dirs(spark, sf_dir))


@query("""WITH t AS (SELECT 's' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.tif' ELSE '.tiff' END AS name FROM customer), p AS (SELECT 's' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.tif' ELSE '.tiff' END AS name FROM customer WHERE c_custkey % 5 <> 0),
k AS (SELECT name, 0 AS r, name AS key FROM t UNION ALL SELECT name, 1, CASE WHEN name LIKE '%.tif' THEN name || 'f' ELSE name[1:len(name) - 1] END FROM t) SELECT k.name AS gt_name, min_by(key, r) AS pred_name FROM k JOIN p ON p.name = key GROUP BY 1""")
def matched_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    name = lambda k: F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % k == 0, ".tif").otherwise(".tiff")).alias("name")
    return paths.matched_files(c.select(name(2)), c.where("c_custkey % 5 != 0").select(name(3)))


# --- augmentation and prediction

_CH = "(((patch + 3 + {s} * 101) * 7919) % 10007) / 10007.0"


def _legendre(t: str) -> list[str]:
    return ["1.0", f"({t})", f"((3 * ({t}) * ({t}) - 1) / 2)", f"((5 * ({t}) * ({t}) * ({t}) - 3 * ({t})) / 2)"]


_FLIPPED = f"(CASE WHEN {_CH.format(s=0)} < 0.5 THEN 7 - y ELSE y END)"
_FIELD = " + ".join(f"0.1 * {_CH.format(s=8 + n)} * {_legendre(f'{_FLIPPED} * 2.0 / 7 - 1')[i]} * {_legendre('x * 2.0 / 7 - 1')[j]}" for n, (i, j) in enumerate((i, j) for i in range(4) for j in range(i + 1)))


@query(f"""WITH {VOX}, p AS (SELECT z AS patch, y, x, v AS img, v * 5 AS msk FROM vox), m AS (SELECT patch, avg(img) AS mu FROM p GROUP BY patch)
SELECT patch, {_FLIPPED} AS y, x, round((((img - mu) * CASE WHEN {_CH.format(s=1)} < 0.3 THEN 0.5 + {_CH.format(s=2)} ELSE 1.0 END + mu)
  * CASE WHEN {_CH.format(s=7)} < 0.2 THEN exp({_FIELD}) ELSE 1.0 END
  + CASE WHEN {_CH.format(s=3)} < 0.3 THEN 0.4 * {_CH.format(s=4)} - 0.2 ELSE 0.0 END) * CASE WHEN {_CH.format(s=5)} < 0.3 THEN 0.8 + 0.4 * {_CH.format(s=6)} ELSE 1.0 END, 6) + 0.0 AS img, CAST(msk > 0.5 AS INT) AS msk FROM p JOIN m USING (patch)""")
def augmented_patches(spark, sf_dir):
    patches = volume(spark, sf_dir).select(F.col("z").alias("patch"), "y", "x", F.col("v").alias("img"), (F.col("v") * 5).alias("msk"))
    return _round(augment.augmented(patches, "patch", 8, 3), "img")


def _whole_slices(spark, sf_dir):
    """The table's rows as slices, without a voxel exploded."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("z"), F.col("embedding").cast("array<double>").alias("data"))
    return rows.select("z", *[F.lit(n).cast("long").alias(c) for c, n in (("y0", 0), ("x0", 0), ("height", 8), ("width", 8))], "data")


@query(f"WITH {_ST} SELECT z, y, x, CAST(CASE WHEN (v - m) / (s + 1e-8) * 2 - 0.5 > -ln(1 / 0.6 - 1) THEN 255 ELSE 0 END AS INT) AS v FROM vox, st")
def segmentation(spark, sf_dir):
    out = predict.segmented_slices(_whole_slices(spark, sf_dir), (depth(spark, sf_dir), 8, 8), SIZE, OVERLAP, predict.linear(2.0, -0.5), probability=0.6)
    return predict.to_voxels(out).withColumn("v", F.col("v").cast("int"))


def _tilted(batch):
    """A model whose logits depend on the place in the patch, so that overlaps of patches and of chunks show."""
    import numpy as np

    d, h, w = (np.arange(n) for n in batch.shape[1:])
    return batch + 0.05 * d[:, None, None] + 0.1 * h[:, None] - 0.2 * w


_CHUNKS = f"""{_ST}, {_TILES}, ex AS (SELECT az.s AS z0, z, y, x, (v - m) / (s + 1e-8) + 0.05 * (z - az.s) + 0.1 * (y - ay.s) - 0.2 * (x - ax.s) AS v
  FROM vox CROSS JOIN (SELECT m, st.s AS s FROM st) n JOIN az ON z >= az.s AND z < az.s + 32 JOIN ay ON y >= ay.s AND y < ay.s + 5 JOIN ax ON x >= ax.s AND x < ax.s + 4),
ch AS (SELECT z0, z, y, x, avg(v) AS v FROM ex GROUP BY 1, 2, 3, 4), bl AS (SELECT z, y, x, list_reduce(list(v ORDER BY z0), lambda p, q: (p + q) / 2) AS v FROM ch GROUP BY 1, 2, 3)"""


@query(f"WITH {_CHUNKS.replace('(v - m) / (s + 1e-8)', '(v - m) / (n.s + 1e-8)')} SELECT z, y, x, CAST(CASE WHEN v > 0.9 THEN 255 ELSE 0 END AS INT) AS v FROM bl")
def chunked_segmentation(spark, sf_dir):
    """Chunks along z that overlap, means over the patches of each, chunks blended in turn."""
    import math

    out = predict.segmented_slices(_whole_slices(spark, sf_dir), (depth(spark, sf_dir), 8, 8), SIZE, OVERLAP, _tilted, probability=1 / (1 + math.exp(-0.9)), band=5)
    return predict.to_voxels(out).withColumn("v", F.col("v").cast("int"))


# --- sources and sinks: written, read back, compared with what went in

_WHOLE = f"WITH {VOX} SELECT z, y, x, v FROM vox"


def _folder(spark, tag: str) -> str:
    return lineage.shared_folder(spark, tag)


@query(_WHOLE)
def tiff_round_trip(spark, sf_dir):
    to = _folder(spark, "tiff")
    volumes.write_slices(volume(spark, sf_dir), to).count()
    return volumes.read_volume(spark, to)


@query(_WHOLE)
def nifti_round_trip(spark, sf_dir):
    to = _folder(spark, "nifti")
    volumes.write_chunks(volume(spark, sf_dir), to, depth(spark, sf_dir), 10, suffix=".nii.gz").count()
    return volumes.read_volume(spark, to)


@query(_WHOLE)
def zarr_round_trip(spark, sf_dir):
    to = _folder(spark, "store") + ".zarr"
    volumes.write_zarr(volume(spark, sf_dir), to, (depth(spark, sf_dir), 8, 8), (10, 5, 8)).count()
    return volumes.read_volume(spark, to)


@query(_WHOLE)
def single_file_round_trip(spark, sf_dir):
    to = _folder(spark, "single")
    volumes.write_single(volume(spark, sf_dir), to, (depth(spark, sf_dir), 8, 8), suffix=".nii.gz").count()
    return volumes.read_volume(spark, to)


@query(_WHOLE)
def block_round_trip(spark, sf_dir):
    to = _folder(spark, "blocks")
    volumes.write_blocks(volume(spark, sf_dir), to)
    return volumes.read_blocks(spark, to)


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z >= 70 AND z < 130")
def region_read(spark, sf_dir):
    """A range of z read from files of the whole volume: only the files that it touches are decoded."""
    to = _folder(spark, "region")
    volumes.write_chunks(volume(spark, sf_dir), to, depth(spark, sf_dir), 10).count()
    return volumes.read_volume(spark, to, z=(70, 130))


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z >= 70 AND z < 130 AND y >= 2 AND y < 7 AND x >= 1 AND x < 4")
def ranged_box(spark, sf_dir):
    """A box read from one file of the whole volume, by ranges of its bytes in many tasks."""
    to = _folder(spark, "ranged")
    volumes.save_slices(_whole_slices(spark, sf_dir), to, "single", ".nii", "float64", shape=(depth(spark, sf_dir), 8, 8))
    return volumes.read_volume(spark, f"{to}/volume.nii", z=(70, 130), y=(2, 7), x=(1, 4))


@query(_WHOLE)
def committed_slices(spark, sf_dir):
    """Rows of slices to files and back, by the sink that commits; no voxel is made between."""
    to = _folder(spark, "committed")
    volumes.save_slices(_whole_slices(spark, sf_dir), to, "slices", ".tif", "float64")
    return volumes.read_volume(spark, to)


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z >= 70 AND z < 130 AND y >= 2 AND y < 7 AND x >= 1 AND x < 4")
def cell_box(spark, sf_dir):
    """A box of Parquet cells in the order of a curve through all three axes."""
    to = _folder(spark, "cells")
    volumes.write_cells(volume(spark, sf_dir), to, 4)
    return volumes.read_cells(spark, to, (70, 130), (2, 7), (1, 4))


@query("SELECT r_name AS source, 'out' AS target FROM region")
def paired_roots(spark, sf_dir):
    names = [r.r_name for r in table(spark, sf_dir, "region").select("r_name").collect()]  # the inputs of a task
    return spark.createDataFrame(convert.pairs(names, ["out"]), "source string, target string")


@query(f"WITH {VOX}, l0 AS (SELECT z, y, x, v FROM vox), {_half(1)} SELECT z, y, x, v FROM l1")
def ome_level_read(spark, sf_dir):
    """The second level of a pyramid in a store."""
    to = _folder(spark, "pyramid") + ".ome.zarr"
    volumes.write_ome_zarr(volume(spark, sf_dir), to, (depth(spark, sf_dir), 8, 8), (64, 8, 8), 2).count()
    return volumes.read_volume(spark, f"{to}/1")


@query(f"WITH {VOX} SELECT z, y, x, CAST(greatest(CAST(-0.1 AS DOUBLE), least(0.2, v)) AS FLOAT)::DOUBLE AS v FROM vox")
def converted_volume(spark, sf_dir):
    """A store turned into slices by a task, clipped on the way."""
    source, to = _folder(spark, "source") + ".zarr", _folder(spark, "converted")
    volumes.write_zarr(volume(spark, sf_dir), source, (depth(spark, sf_dir), 8, 8), (64, 8, 8)).count()
    convert.run(spark, {"inputs": [source], "outputs": [to], "kinds": ["Scroll-Tif"], "low": -0.1, "high": 0.2})
    return volumes.read_volume(spark, to)


@query(_WHOLE)
def named_slices(spark, sf_dir):
    vox, to = volume(spark, sf_dir), _folder(spark, "named")
    names = vox.select("z").distinct().withColumn("name", F.format_string("scan_%05d.tif", "z"))
    volumes.write_named(vox, to, names).count()
    return volumes.read_volume(spark, to)


@query(f"WITH {_ST} SELECT z, y, x, CAST(CASE WHEN (v - m) / (s * 1.5 + 1e-8) * 2 - 0.5 > 0 THEN 65535 ELSE 0 END AS DOUBLE) AS v FROM vox, st")
def configured_inference(spark, sf_dir):
    """A folder of slices segmented by a stored model, as a configuration says, and the mask read back."""
    root, net = _folder(spark, "project"), _folder(spark, "net")
    volumes.write_slices(volume(spark, sf_dir), f"{root}/a/images").count()
    predict.save_checkpoint(spark, net, "linear", {"weight": 2.0, "bias": -0.5}, 1, 0.1)
    own = {"input_path": root, "input_name": "images", "output_name": "mask", "model_path": net, "inference_patch_size": list(SIZE), "inference_overlay": list(OVERLAP), "preprocess": {"normalize_mode": "z-score"}, "output": {"type": "Scroll-Tiff"}}
    jobs.inference(spark, {"normalization": {"z-score": {"std_multiplier": 1.5}}, "inference": own})
    return volumes.read_volume(spark, f"{root}/a/mask.scroll-tiff")


@query("SELECT 'linear' AS model, CAST(count(*) AS BIGINT) AS epoch, round(avg(n_nationkey), 6) AS loss, CAST(count(*) * 3.0 + 1 AS DOUBLE) AS logit FROM nation")
def checkpoint_read(spark, sf_dir):
    """A model's parameters written and read back; what the model makes of 3."""
    import numpy as np

    r, to = table(spark, sf_dir, "nation").agg(F.count("*").alias("n"), F.round(F.avg("n_nationkey"), 6).alias("loss")).first(), _folder(spark, "checkpoint")
    predict.save_checkpoint(spark, to, "linear", {"weight": float(r.n), "bias": 1.0}, r.n, r.loss)
    model, stored = predict.load_checkpoint(spark, to)
    return spark.createDataFrame([(stored["model"], stored["epoch"], stored["loss"], float(model(np.array([3.0]))[0]))], "model string, epoch long, loss double, logit double")


@query(f"WITH {VOX}, s AS (SELECT depth * 64 * 4 / 1073741824.0 AS gb FROM dim) SELECT n_nationkey AS k, gb <= n_nationkey * 0.00005 * 0.5 AS fits FROM nation, s")
def memory_guard(spark, sf_dir):
    """Whether the volume fits half of a limit, for some limits."""
    gb = stats.metadata(volume(spark, sf_dir)).first().size_gb
    limits = [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(k, stats.fits_memory(gb, k * 0.00005)) for k in limits], "k int, fits boolean")


@query(f"WITH {_EXTRACT} SELECT z0 AS pz, y0 AS py, x0 AS px, count(DISTINCT z) AS pieces FROM ex GROUP BY 1, 2, 3")
def patch_pieces(spark, sf_dir):
    out = predict.patches(_whole_slices(spark, sf_dir), (depth(spark, sf_dir), 8, 8), SIZE, OVERLAP)
    return out.select("pz", "py", "px", F.size("pieces").cast("long").alias("pieces"))


@query("SELECT CAST(vec_id AS BIGINT) AS z, round(list_sum([CAST(e AS DOUBLE) * 2 + 1 for e in embedding]), 6) + 0.0 AS total, round(CAST(embedding[64] AS DOUBLE) * 2 + 1, 6) + 0.0 AS first FROM embeddings")
def transformed_samples(spark, sf_dir):
    """A user's function over batches of samples: reversed, doubled, moved by one."""
    out = predict.transformed(_whole_slices(spark, sf_dir), lambda batch: batch[:, ::-1] * 2 + 1, ["z"])
    return out.select("z", r6(F.aggregate("data", F.lit(0.0), lambda a, v: a + v)).alias("total"), r6(F.get("data", F.lit(0))).alias("first"))


@query(f"WITH {_DETAIL} SELECT CAST(model AS VARCHAR) AS model, {', '.join(f'round(avg({n}), 6) + 0.0 AS {n}_mean' for n in ('accuracy', 'precision', 'recall', 'f1', 'mcc', 'hausdorff', 'pr_auc'))} FROM dt GROUP BY model")
def report_files(spark, sf_dir):
    """The summary as it stands in its file."""
    to, details = _folder(spark, "report"), _details(spark, sf_dir)
    report.write(details, report.summary(details), to, "image", "model")
    names = [f"{n}_mean" for n in ("accuracy", "precision", "recall", "f1", "mcc", "hausdorff", "pr_auc")]
    return spark.read.option("header", True).csv(f"{to}/summary").select("model", *[r6(F.col(n).cast("double")).alias(n) for n in names])


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(min(value), 6) + 0.0 AS min FROM events GROUP BY 1, 2")
def windowed_stream(spark, sf_dir):
    """Statistics of days of event time, the table read as a stream to its end."""
    import uuid

    kinds = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), F.col("value").alias("v"))
    name = f"stream_{uuid.uuid4().hex}"
    out = slices.windowed_statistics(rows, "at", "1 day", "1 day", "kind")
    out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.to_date("window.start").cast("string").alias("day"), "kind", "n", r6("mean").alias("mean"), r6("min").alias("min"))


@query("SELECT event_type AS kind, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max FROM events GROUP BY 1")
def streamed_statistics(spark, sf_dir):
    """The table read as a stream to its end; the state's last content."""
    import uuid

    kinds = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").select(F.col("event_type").alias("kind"), F.col("value").alias("v"))
    name = f"stream_{uuid.uuid4().hex}"
    q = slices.running_statistics(rows, "kind").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return _round(spark.table(name), "mean", "std", "min", "max")
