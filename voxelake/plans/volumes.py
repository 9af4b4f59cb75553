"""Queries over voxel grids: scales, tissue, resampling, fusion, shape, structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import rules, scalar
from voxelake.operators import graph, histogram, resample, shape, slabs, tissue
from voxelake.plans.registry import query, registry_sql
from voxelake.sources import grids, layout
from voxelake.sources.grids import FS_SQL, T1_SQL, fatsat_voxels, t1_voxels
from voxelake.sources.shared import materialize

NX = NY = 8

SEVENTH = " WHERE idx % 7 = 0"  # what a scale counts in the queries that take every seventh voxel
HIST_SQL = f"""h AS (SELECT v, bin, count(*) AS n FROM (SELECT v, CAST(floor((stored - lo) * (1023.0 / (hi - lo)) + 0.5) AS INTEGER) AS bin FROM vox JOIN rng USING (v){SEVENTH}) GROUP BY v, bin),
c AS (SELECT v, bin, n, sum(n) OVER (PARTITION BY v ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY v) AS total FROM h)"""
BOTH_SQL = f"{T1_SQL}, {FS_SQL}, vox AS (SELECT 't1' AS v, * FROM t1 UNION ALL SELECT 'fs', * FROM fs), rng AS (SELECT v, min(stored) AS lo, max(stored) AS hi FROM vox GROUP BY v), {HIST_SQL}"
SCALE_SQL = f"""{BOTH_SQL},
top AS (SELECT v, floor(min(bin) FILTER (WHERE upto >= total * 0.998) * 0.12 + 0.5) AS fl FROM c GROUP BY v),
b AS (SELECT v, bin, sum(n) OVER (PARTITION BY v ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY v) AS body FROM h JOIN top USING (v) WHERE bin >= fl),
scale AS (SELECT v, greatest(min(bin) FILTER (WHERE seen * 2 >= body) / 1023.0 / 0.3, 0.0001) AS high FROM b GROUP BY v),
sig AS (SELECT vox.v, k, j, i, idx, least(1.0, greatest(0.0, ((stored - lo) / CAST(hi - lo AS DOUBLE)) / greatest(high, 0.000001))) AS s FROM vox JOIN rng USING (v) JOIN scale USING (v))"""
PAIR = rules.sql_pair("a.s", "f.s")
TISSUE_SQL = f"{SCALE_SQL}, tis AS (SELECT a.k, a.j, a.i, a.idx, {PAIR[0]} AS tissue, {PAIR[1]} AS confidence FROM sig a JOIN sig f ON a.idx = f.idx AND a.v = 't1' AND f.v = 'fs')"


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t1_voxels(spark, sf_dir).unionByName(fatsat_voxels(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.classify(t1_voxels(spark, sf_dir), fatsat_voxels(spark, sf_dir))


@query("agg2_value_range", f"WITH {T1_SQL}, {FS_SQL} SELECT 't1' AS volume_id, min(stored) AS lo, max(stored) AS hi FROM t1 UNION ALL SELECT 'fs', min(stored), max(stored) FROM fs")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.value_ranges(both(spark, sf_dir))


@query("agg3_percentile_range", f"WITH {BOTH_SQL}, q AS (SELECT v, min(bin) FILTER (WHERE upto >= total * 0.01) / 1023.0 AS a, min(bin) FILTER (WHERE upto >= total * 0.995) / 1023.0 AS b FROM c GROUP BY v) SELECT v AS volume_id, round(a, 6) AS low, round(greatest(b, a + 0.0001), 6) AS high FROM q")
def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.percentile_ranges(both(spark, sf_dir)).select("volume_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("agg4_muscle_scale", f"WITH {SCALE_SQL} SELECT v AS volume_id, lo, hi, round(high, 6) AS high FROM scale JOIN rng USING (v)")
def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.muscle_ranges(both(spark, sf_dir)).select("volume_id", "lo", "hi", F.round("high", 6).alias("high"))


@query("agg8_tissue_tally", f"WITH {TISSUE_SQL} SELECT t.tissue, count(tis.idx) AS n FROM (VALUES ('background'), ('fat'), ('muscle'), ('fluid'), ('edema'), ('dark'), ('unknown')) t(tissue) LEFT JOIN tis ON tis.tissue = t.tissue GROUP BY t.tissue")
def agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.tally(classified(spark, sf_dir))


@query("rul3_classify_pair", f"WITH {TISSUE_SQL} SELECT idx, tissue, round(confidence, 6) AS confidence FROM tis")
def rul3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("idx", "tissue", F.round("confidence", 6).alias("confidence"))


SINGLE_FS = f"CASE WHEN s < {rules.FATSAT.noise!r} THEN 'background' WHEN s >= {rules.FATSAT.high!r} THEN 'fluid' WHEN s >= {rules.FATSAT.low!r} THEN 'muscle' ELSE 'dark' END"


@query("rul4_classify_single", f"WITH {SCALE_SQL} SELECT {SINGLE_FS} AS tissue, count(*) AS n, round(sum(CASE WHEN s < {rules.FATSAT.noise!r} THEN 1.0 ELSE {rules.sql_margin('s', rules.FATSAT)} * 0.5 END), 4) AS confidence FROM sig WHERE v = 'fs' GROUP BY 1")
def rul4(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = histogram.signals(fatsat_voxels(spark, sf_dir))
    t, c = rules.classify_single(F.lit(None).cast("double"), F.col("signal"))
    return s.select(t.alias("tissue"), c.alias("c")).groupBy("tissue").agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("confidence"))


@query("prj14_bit_mask", f"WITH {T1_SQL}, m AS (SELECT k, (stored >> 2) & 255 AS v FROM t1) SELECT k, CAST(sum(CASE WHEN v >= 128 THEN v - 256 ELSE v END) AS BIGINT) AS total, min(CASE WHEN v >= 128 THEN v - 256 ELSE v END) AS lo, max(CASE WHEN v >= 128 THEN v - 256 ELSE v END) AS hi FROM m GROUP BY k")
def prj14(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scalar.bit_mask(F.col("stored"), allocated=16, stored=8, high_bit=9, signed=True)
    return t1_voxels(spark, sf_dir).select("k", v.alias("v")).groupBy("k").agg(F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("prj17_rescale", f"WITH {T1_SQL} SELECT k, sum(CAST(stored * 2 - 1024 AS DOUBLE)) AS total, max(CAST(stored * 2 - 1024 AS DOUBLE)) AS top FROM t1 GROUP BY k")
def prj17(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scalar.rescale(F.col("stored"), 2, -1024).cast("double")
    return t1_voxels(spark, sf_dir).groupBy("k").agg(F.sum(v).alias("total"), F.max(v).alias("top"))


@query("prj18_window_gray", f"WITH {T1_SQL} SELECT idx, CAST(floor(least(1.0, greatest(0.0, (stored - (2000 - 600 / 2.0)) / 600.0)) * 255 + 0.5) AS INTEGER) AS gray FROM t1")
def prj18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t1_voxels(spark, sf_dir).select("idx", F.floor(scalar.window_level(F.col("stored"), 2000, 600) * 255 + 0.5).cast("int").alias("gray"))


@query("prj19_signal", f"WITH {SCALE_SQL} SELECT v AS volume_id, k, round(sum(s), 5) AS total FROM sig GROUP BY v, k")
def prj19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.signals(both(spark, sf_dir)).groupBy("volume_id", "k").agg(F.round(F.sum("signal"), 5).alias("total"))


@query("rul11_default_window", f"WITH {BOTH_SQL}, q AS (SELECT v, lo, hi, min(bin) FILTER (WHERE upto >= total * 0.01) / 1023.0 AS a, min(bin) FILTER (WHERE upto >= total * 0.995) / 1023.0 AS b FROM c JOIN rng USING (v) GROUP BY v, lo, hi), w AS (SELECT v, lo + (a + b) / 2 * (hi - lo) AS center, (b - a) * (hi - lo) AS width FROM q) SELECT v AS volume_id, round(CASE WHEN 300 < width / 3 THEN center ELSE 2000 END, 4) AS center, round(CASE WHEN 300 < width / 3 THEN width ELSE 300 END, 4) AS width FROM w")
def rul11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's window (2000, 300) unless it is narrower than a third of the measured one."""
    v = both(spark, sf_dir)
    q = histogram.percentile_ranges(v).join(histogram.value_ranges(v), "volume_id")
    span = F.col("hi") - F.col("lo")
    center, width = F.col("lo") + (F.col("low") + F.col("high")) / 2 * span, (F.col("high") - F.col("low")) * span
    bad = F.lit(300.0) < width / 3
    return q.select("volume_id", F.round(F.when(bad, center).otherwise(2000.0), 4).alias("center"), F.round(F.when(bad, width).otherwise(300.0), 4).alias("width"))


@query("agg15_coarsen", f"WITH {T1_SQL}, n AS (SELECT max(k) + 1 AS nz FROM t1) SELECT k // 3 AS k, j // 3 AS j, i // 3 AS i, round(avg(stored), 6) AS mean FROM t1, n WHERE i // 3 < 2 AND j // 3 < 2 AND k // 3 < nz // 3 GROUP BY 1, 2, 3")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t1_voxels(spark, sf_dir)
    sized = slabs.per_volume(v, grids.dims(v))
    return resample.blocks(sized, 3, 3, 3, F.col("nx"), F.col("ny"), F.col("nz")).select("k", "j", "i", F.round("mean", 6).alias("mean"))


@query("agg16_preview", f"WITH {T1_SQL} SELECT k, j // 2 AS j, i // 2 AS i, CAST(floor(avg(stored) + 0.5) AS BIGINT) AS stored FROM t1 GROUP BY 1, 2, 3")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t1_voxels(spark, sf_dir)
    sized = slabs.per_volume(v, grids.dims(v))
    return resample.blocks(sized, 2, 2, 1, F.col("nx"), F.col("ny"), F.col("nz")).select("k", "j", "i", scalar.half_up(F.col("mean")).alias("stored"))


# --- cross-grid reads: the T1 grid's voxels seen in the other grid ---

POINTS_SQL = "pts AS (SELECT idx, i * 1.0 + 0.25 AS x, j * 0.9 + 0.5 AS y, k * 1.0 - 0.25 AS z FROM t1)"
TRI_SQL = """ax AS (SELECT idx, least(greatest(x, 0.0), 7.0) AS x, least(greatest(y, 0.0), 7.0) AS y, least(greatest(z, 0.0), nz - 1.0) AS z, nz FROM pts, (SELECT max(k) + 1 AS nz FROM fs) d WHERE x >= -0.5 AND y >= -0.5 AND z >= -0.5 AND x <= 7.5 AND y <= 7.5 AND z <= nz - 0.5),
cr AS (SELECT idx, (least(floor(z) + c, nz - 1) * 64 + least(floor(y) + b, 7) * 8 + least(floor(x) + a, 7)) AS at, abs(1 - a - (x - floor(x))) * abs(1 - b - (y - floor(y))) * abs(1 - c - (z - floor(z))) AS w FROM ax, range(2) ra(a), range(2) rb(b), range(2) rc(c))"""


def moved_points(v: DataFrame, other: DataFrame) -> DataFrame:
    return v.select("idx", (F.col("i") * 1.0 + 0.25).alias("x"), (F.col("j") * 0.9 + 0.5).alias("y"), (F.col("k") * 1.0 - 0.25).alias("z")).join(grids.dims(other))


@query("join2_trilinear", f"WITH {T1_SQL}, {FS_SQL}, {POINTS_SQL}, {TRI_SQL} SELECT cr.idx, round(sum(w * stored), 5) AS value FROM cr JOIN fs ON fs.idx = cr.at GROUP BY cr.idx")
def join2(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = fatsat_voxels(spark, sf_dir)
    got = resample.trilinear(moved_points(t1_voxels(spark, sf_dir), fs).withColumnRenamed("idx", "of"), fs, ["of"])
    return got.select(F.col("of").alias("idx"), F.round("value", 5).alias("value"))


@query("geo10_sample_nearest", f"WITH {T1_SQL}, {FS_SQL}, {POINTS_SQL} SELECT p.idx, fs.stored FROM pts p LEFT JOIN fs ON fs.i = floor(p.x + 0.5) AND fs.j = floor(p.y + 0.5) AND fs.k = floor(p.z + 0.5)")
def geo10(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = fatsat_voxels(spark, sf_dir)
    got = resample.nearest(moved_points(t1_voxels(spark, sf_dir), fs).withColumnRenamed("idx", "of"), fs)
    return got.select(F.col("of").alias("idx"), "stored")


@query("geo17_slab_mip", f"WITH {T1_SQL} SELECT j, i, s AS slab, max(stored) AS top, min(k) FILTER (WHERE r = 1) AS at_k FROM (SELECT *, k // 16 AS s, rank() OVER (PARTITION BY j, i, k // 16 ORDER BY stored DESC) AS r FROM t1) GROUP BY j, i, s")
def geo17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum over slabs of 16 slices, and the first slice that has it."""
    best = F.max(F.struct("stored", (-F.col("k")).alias("back")))
    return t1_voxels(spark, sf_dir).groupBy("j", "i", F.floor(F.col("k") / 16).alias("slab")).agg(best.alias("b")).select("j", "i", "slab", F.col("b.stored").alias("top"), (-F.col("b.back")).alias("at_k"))


@query("geo18_gradient", f"WITH {T1_SQL}, g AS (SELECT idx, i, j, (lead(stored) OVER x - lag(stored) OVER x) / 2.0 AS gx, (lead(stored) OVER y - lag(stored) OVER y) / 2.0 AS gy, (lead(stored) OVER z - lag(stored) OVER z) / 2.0 AS gz FROM t1 WINDOW x AS (PARTITION BY k, j ORDER BY i), y AS (PARTITION BY k, i ORDER BY j), z AS (PARTITION BY j, i ORDER BY k)) SELECT idx, gx, gy, gz FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL AND gz IS NOT NULL")
def geo18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central differences: each voxel sends half its value to its six neighbours, signed."""
    v = t1_voxels(spark, sf_dir)
    nz = v.agg(F.max("k") + 1).first()[0]
    near = graph.shifted(v, graph.SIX, NX, NY, nz, ["stored"])
    half = lambda c: F.sum(F.when(F.col(f"o.{c}") != 0, -F.col(f"o.{c}") * F.col("stored") / 2.0))
    got = near.groupBy("at").agg(half("di").alias("gx"), half("dj").alias("gy"), half("dk").alias("gz"), F.count("*").alias("n"))
    return got.filter("n = 6").select(F.col("at").alias("idx"), "gx", "gy", "gz")


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two volumes with their affines: the second one moved and with thicker slices."""
    d = grids.dims(both(spark, sf_dir))
    one, two = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0], [1.0, 0, 0, 0.5, 0, 1.0, 0, 0.25, 0, 0, 1.25, 1.0]
    lit = lambda m: F.array(*(F.lit(float(x)) for x in m))
    first = F.col("volume_id") == "t1"
    return d.withColumn("m", F.when(first, lit(one)).otherwise(lit(two))).withColumn("spacing", F.when(first, lit([1, 1, 1])).otherwise(lit([1, 1, 1.25])))


FUSE_SQL = f"""WITH {SCALE_SQL}, nz AS (SELECT max(k) + 1 AS n FROM t1),
g AS (SELECT 9 AS gx, 9 AS gy, CAST(ceil(greatest(n - 0.5, (n - 0.5) * 1.25 + 1) - least(-0.5, -0.5 * 1.25 + 1)) AS BIGINT) AS gz FROM nz),
cell AS (SELECT idx, -0.5 + idx % gx AS px, -0.5 + (idx // gx) % gy AS py, -0.5 + idx // (gx * gy) AS pz FROM (SELECT gx, gy, unnest(range(gx * gy * gz)) AS idx FROM g)),
p AS (SELECT idx, 't1' AS v, px AS x, py AS y, pz AS z FROM cell UNION ALL SELECT idx, 'fs', px - 0.5, py - 0.25, (pz - 1) / 1.25 FROM cell),
ins AS (SELECT p.*, n FROM p, nz WHERE x >= 0 AND y >= 0 AND z >= -0.5 AND x <= 7 AND y <= 7 AND z <= n - 0.5),
cl AS (SELECT idx, v, x, y, least(greatest(z, 0.0), n - 1.0) AS z, n FROM ins),
cr AS (SELECT idx, v, (least(floor(z) + c, n - 1) * 64 + least(floor(y) + b, 7) * 8 + least(floor(x) + a, 7)) AS at, abs(1 - a - (x - floor(x))) * abs(1 - b - (y - floor(y))) * abs(1 - c - (z - floor(z))) AS w FROM cl, range(2) ra(a), range(2) rb(b), range(2) rc(c)),
rd AS (SELECT cr.idx, cr.v, sum(w * stored) AS value FROM cr JOIN vox ON vox.v = cr.v AND vox.idx = cr.at GROUP BY cr.idx, cr.v),
sg AS (SELECT rd.idx, least(1.0, greatest(0.0, (value - lo) / (high * (hi - lo)))) AS s FROM rd JOIN rng USING (v) JOIN scale USING (v))
SELECT cell.idx, CAST(coalesce(floor(avg(s) * 4095 + 0.5), 0) AS INTEGER) AS value, CAST(count(s) AS INTEGER) AS n_sources FROM cell LEFT JOIN sg USING (idx) GROUP BY cell.idx"""


@query("agg14_fuse", FUSE_SQL)
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = both(spark, sf_dir), study(spark, sf_dir)
    return resample.fuse(s, v, histogram.muscle_ranges(v), resample.plan_fusion(s))


# --- graph ---

DARK = "stored < 1800"
GRF3_SQL = f"""WITH RECURSIVE {T1_SQL}, d AS (SELECT * FROM t1 WHERE {DARK}),
e AS (SELECT a.idx AS a, b.idx AS b FROM d a JOIN d b ON (b.idx = a.idx + 1 AND a.i < 7) OR (b.idx = a.idx + 8 AND a.j < 7) OR b.idx = a.idx + 64),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT idx, idx AS c FROM d UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.idx WHERE s.b > r.c)
SELECT idx, min(c) AS component FROM r GROUP BY idx"""


@query("grf3_components", GRF3_SQL)
def grf3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t1_voxels(spark, sf_dir)
    return graph.components(v.filter(DARK), slabs.grid_of(v), graph.SIX).select("idx", "component")


@query("grf1_dark_wall", f"WITH {TISSUE_SQL}, d AS (SELECT * FROM tis WHERE tissue = 'dark'), w AS (SELECT idx FROM d UNION SELECT c.idx FROM tis c JOIN d a ON a.idx = c.idx - 1 JOIN d b ON b.idx = c.idx + 1 WHERE c.i BETWEEN 1 AND 6 UNION SELECT c.idx FROM tis c JOIN d a ON a.idx = c.idx - 8 JOIN d b ON b.idx = c.idx + 8 WHERE c.j BETWEEN 1 AND 6 UNION SELECT c.idx FROM tis c JOIN d a ON a.idx = c.idx - 64 JOIN d b ON b.idx = c.idx + 64) SELECT idx FROM w")
def grf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dark_wall(classified(spark, sf_dir), slabs.grid_of(t1_voxels(spark, sf_dir))).select("idx")


MARROW_SQL = f"""WITH RECURSIVE {TISSUE_SQL}, nz AS (SELECT max(k) + 1 AS n FROM tis), d AS (SELECT idx FROM tis WHERE tissue = 'dark'),
w AS (SELECT idx FROM d UNION SELECT c.idx FROM tis c JOIN d a ON a.idx = c.idx - 1 JOIN d b ON b.idx = c.idx + 1 WHERE c.i BETWEEN 1 AND 6 UNION SELECT c.idx FROM tis c JOIN d a ON a.idx = c.idx - 8 JOIN d b ON b.idx = c.idx + 8 WHERE c.j BETWEEN 1 AND 6 UNION SELECT c.idx FROM tis c JOIN d a ON a.idx = c.idx - 64 JOIN d b ON b.idx = c.idx + 64),
o AS (SELECT k, j, i, idx FROM tis WHERE idx NOT IN (SELECT idx FROM w)),
e AS (SELECT a.idx AS a, b.idx AS b FROM o a JOIN o b ON (b.idx = a.idx + 1 AND a.i < 7) OR (b.idx = a.idx + 8 AND a.j < 7) OR b.idx = a.idx + 64),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT idx FROM o, nz WHERE i IN (0, 7) OR j IN (0, 7) OR k IN (0, n - 1) UNION SELECT s.b FROM r JOIN s ON s.a = r.idx)
SELECT CASE WHEN tissue = 'fat' AND r.idx IS NULL THEN 'pocket' ELSE tissue END AS tissue, count(*) AS n FROM tis LEFT JOIN r USING (idx) GROUP BY 1"""


@query("grf2_enclosed_fat", MARROW_SQL)
def grf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tissue counts with enclosed fat apart, pockets of any size (the size rule is the tests')."""
    t = materialize(classified(spark, sf_dir).select("volume_id", "idx", "k", "j", "i", "tissue"), "tissue")
    m = graph.mark_marrow(t, slabs.grid_of(t), least=1)
    return m.groupBy(F.when(F.col("tissue") == "marrow", "pocket").otherwise(F.col("tissue")).alias("tissue")).agg(F.count("*").alias("n"))


# --- shape ---

SPACING = (1.0, 1.0, 1.0)


@query("shp3_hessian", f"""WITH {T1_SQL}, n AS (SELECT max(k) + 1 AS nz FROM t1), g AS (SELECT c.idx, a.di, a.dj, a.dk, v.stored AS s FROM t1 c, n, (SELECT x AS di, y AS dj, z AS dk FROM range(-1, 2) a(x), range(-1, 2) b(y), range(-1, 2) c(z)) a JOIN t1 v ON v.idx = c.idx + a.di + 8 * a.dj + 64 * a.dk WHERE c.i BETWEEN 1 AND 6 AND c.j BETWEEN 1 AND 6 AND c.k BETWEEN 1 AND nz - 2)
SELECT idx, CAST(sum(CASE WHEN dj = 0 AND dk = 0 THEN CASE di WHEN 0 THEN -2 ELSE 1 END * s ELSE 0 END) AS DOUBLE) AS xx, CAST(sum(CASE WHEN di = 0 AND dk = 0 THEN CASE dj WHEN 0 THEN -2 ELSE 1 END * s ELSE 0 END) AS DOUBLE) AS yy, CAST(sum(CASE WHEN di = 0 AND dj = 0 THEN CASE dk WHEN 0 THEN -2 ELSE 1 END * s ELSE 0 END) AS DOUBLE) AS zz,
sum(CASE WHEN dk = 0 THEN di * dj * s ELSE 0 END) / 4.0 AS xy, sum(CASE WHEN dj = 0 THEN di * dk * s ELSE 0 END) / 4.0 AS xz, sum(CASE WHEN di = 0 THEN dj * dk * s ELSE 0 END) / 4.0 AS yz FROM g GROUP BY idx""")
def shp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t1_voxels(spark, sf_dir).withColumnRenamed("stored", "value")
    return shape.hessian(f, slabs.grid_of(f, SPACING)).drop("volume_id")


M6 = [f"CAST(embedding[{n}] AS DOUBLE)" for n in range(1, 7)]
EIGEN_SQL = f"""m AS (SELECT vec_id, {', '.join(f'{x} AS {n}' for x, n in zip(M6, ('xx', 'yy', 'zz', 'xy', 'xz', 'yz'), strict=True))} FROM embeddings),
c AS (SELECT *, (xx + yy + zz) / 3 AS t, xy * xy + xz * xz + yz * yz AS off FROM m),
r AS (SELECT *, sqrt(((xx - t) * (xx - t) + (yy - t) * (yy - t) + (zz - t) * (zz - t) + 2 * off) / 6) AS rad FROM c),
d AS (SELECT *, ((xx - t) * ((yy - t) * (zz - t) - yz * yz) - xy * (xy * (zz - t) - yz * xz) + xz * (xy * yz - (yy - t) * xz)) / (rad * rad * rad) AS det FROM r),
a AS (SELECT *, acos(least(1.0, greatest(-1.0, det / 2))) / 3 AS ang FROM d),
e AS (SELECT vec_id, t + 2 * rad * cos(ang) AS e1, t + 2 * rad * cos(ang + 2 * pi() / 3) AS e3, t FROM a),
l AS (SELECT vec_id, list_sort([{{'s': abs(x), 'x': x}} FOR x IN [e1, 3 * t - e1 - e3, e3]]) AS l FROM e),
ev AS (SELECT vec_id, l[1].x AS l1, l[2].x AS l2, l[3].x AS l3 FROM l)"""


@query("shp4_eigen", f"WITH {EIGEN_SQL} SELECT vec_id, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3 FROM ev")
def shp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = matrices(spark, sf_dir)
    return e.select("vec_id", *(F.round(F.get("e", F.lit(n)), 6).alias(f"l{n + 1}") for n in range(3)))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *(F.get("embedding", F.lit(n)).cast("double").alias(c) for n, c in enumerate(("xx", "yy", "zz", "xy", "xz", "yz"))))
    return m.select("vec_id", shape.eigenvalues(*(F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz"))).alias("e"))


@query("shp7_shape", f"""WITH {EIGEN_SQL}, q AS (SELECT vec_id, l3, greatest(l2, 0.0) / l3 AS mid, abs(l1) / l3 AS low, 1 - exp(-(l3 * l3) / (2 * 0.05 * 0.05)) AS strength, greatest(0.0, -l2) / l3 AS saddle FROM ev WHERE l3 > 0),
s AS (SELECT *, mid * (1 - low) AS tube, 1 - mid AS sheet, low AS blob FROM q),
k AS (SELECT *, greatest(tube, sheet, blob) AS top, list_sort([tube, sheet, blob])[2] AS second FROM s),
f AS (SELECT vec_id, CASE WHEN tube = top THEN 'tube' WHEN sheet = top THEN 'sheet' ELSE 'blob' END AS kind, least(1.0, greatest(0.0, (top - second) * strength * (1 - saddle))) AS c FROM k)
SELECT ev.vec_id, CASE WHEN coalesce(c, 0) <= 0 THEN 'none' ELSE kind END AS kind, round(coalesce(c, 0), 6) AS confidence FROM ev LEFT JOIN f USING (vec_id)""")
def shp7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, sure = shape.shape(*(F.get("e", F.lit(n)) for n in range(3)))
    return matrices(spark, sf_dir).select("vec_id", kind.alias("kind"), F.round(sure, 6).alias("confidence"))


@query("shp2_smooth")
def shp2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t1_voxels(spark, sf_dir).withColumnRenamed("stored", "value")
    return shape.smooth(f, 0.7, slabs.grid_of(f, SPACING)).drop("volume_id")


@query("shp8_shapes")
def shp8(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = histogram.signals(t1_voxels(spark, sf_dir)).withColumnRenamed("signal", "value")
    return shape.shapes(f, slabs.grid_of(f, SPACING)).drop("volume_id")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark structures end to end: tissue, marrow, shape, groups, contacts, evidence, names."""
    v = t1_voxels(spark, sf_dir)
    return structures_of(classified(spark, sf_dir), histogram.signals(v).withColumnRenamed("signal", "value"), slabs.grid_of(v, SPACING))


def structures_of(classes: DataFrame, field: DataFrame, grid: DataFrame) -> DataFrame:
    """Evidence of the structures of every volume of ``grid``, from its tissue and its signal (value)."""
    t = materialize(classes.select("volume_id", "idx", "k", "j", "i", "tissue"), "tissue")
    marked = materialize(graph.mark_marrow(t, grid), "marked")
    # the driver's grids are noise without real structures: the bars for shapes are lowered
    seen = shape.shapes(field, grid, least=0.0)
    dark = materialize(marked.filter("tissue = 'dark'").join(seen, ["volume_id", "idx"]).select("volume_id", "idx", "k", "j", "i", "kind", "confidence"), "shapes")
    groups = materialize(graph.shape_groups(dark, grid, seed=0.01), "groups")
    ends = materialize(graph.split_ends(groups, grid), "ends")
    return graph.evidence(groups, ends, dark, graph.contacts(ends, marked, grid))


@query("grf11_structures")
def grf11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, why = rules.name_component(graph.evidence_columns())
    return structures(spark, sf_dir).select("component_id", "kind", "voxels", F.round("agreement", 6).alias("agreement"), F.round("length_mm", 6).alias("length_mm"), s.alias("structure"), F.round(c, 6).alias("confidence"), why.alias("reason"))


CONTACT_SQL = f"""WITH {TISSUE_SQL}, nz AS (SELECT max(k) + 1 AS n FROM tis), d AS (SELECT * FROM tis WHERE tissue = 'dark'),
s AS (SELECT d.idx, di, dj, dk, t, ((d.k + dk * t) * 8 + d.j + dj * t) * 8 + d.i + di * t AS at FROM d, nz, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(di, dj, dk), range(1, 9) r(t) WHERE d.i + di * t BETWEEN 0 AND 7 AND d.j + dj * t BETWEEN 0 AND 7 AND d.k + dk * t BETWEEN 0 AND n - 1),
m AS (SELECT s.idx, arg_min(x.tissue, t) AS met FROM s JOIN tis x ON x.idx = s.at WHERE x.tissue <> 'dark' GROUP BY s.idx, di, dj, dk)
SELECT met AS tissue, count(*) AS n FROM m GROUP BY met"""


@query("join14_contacts", CONTACT_SQL)
def join14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rays from all dark voxels meet first, within 8 mm."""
    names = tuple(t for t in rules.TISSUES if t != "dark")
    met = graph.rays_met(classified(spark, sf_dir), slabs.grid_of(t1_voxels(spark, sf_dir)), 8.0, names)
    codes = met.select(F.explode(F.array(*(f"r{n}" for n in range(6)))).alias("code")).filter("code >= 0")
    return codes.groupBy(F.get(F.array(*map(F.lit, names)), F.col("code").cast("int")).alias("tissue")).agg(F.count("*").alias("n"))


# --- two studies of different size in one call: every third slice is of the second ---

#: Slices of t1 and fs in the order of their own study (s).
STUDY_SQL = ", ".join(f"{v}2 AS (SELECT CASE WHEN k % 3 = 0 THEN 'b' ELSE 'a' END AS s, CASE WHEN k % 3 = 0 THEN k // 3 ELSE k - k // 3 - 1 END AS k, j, i, stored FROM {v})" for v in ("t1", "fs"))


def two_studies(voxels: DataFrame) -> DataFrame:
    """The voxels with study_id, and with volume_id, k and idx of their own study."""
    second, whole = F.col("k") % 3 == 0, F.floor(F.col("k") / 3)
    s = voxels.withColumn("study_id", F.when(second, "b").otherwise("a")).withColumn("k", F.when(second, whole).otherwise(F.col("k") - whole - 1).cast("int"))
    return s.withColumn("volume_id", F.concat_ws(" ", "study_id", "volume_id")).withColumn("idx", (F.col("k") * (NX * NY) + F.col("j") * NX + F.col("i")).cast("long"))


@query(
    "grf3_two_studies",
    f"""WITH RECURSIVE {T1_SQL}, {FS_SQL}, {STUDY_SQL}, d AS (SELECT s, k, j, i, k * 64 + j * 8 + i AS idx FROM t12 WHERE {DARK}),
e AS (SELECT a.s, a.idx AS a, b.idx AS b FROM d a JOIN d b ON a.s = b.s AND ((b.idx = a.idx + 1 AND a.i < 7) OR (b.idx = a.idx + 8 AND a.j < 7) OR b.idx = a.idx + 64)),
u AS (SELECT s, a, b FROM e UNION ALL SELECT s, b, a FROM e),
r AS (SELECT s, idx, idx AS c FROM d UNION SELECT u.s, u.b, r.c FROM r JOIN u ON u.s = r.s AND u.a = r.idx WHERE u.b > r.c)
SELECT s || ' t1' AS volume_id, idx, min(c) AS component FROM r GROUP BY s, idx""",
)
def grf3_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = two_studies(t1_voxels(spark, sf_dir))
    return graph.components(v.filter(DARK), slabs.grid_of(v), graph.SIX)


@query(
    "join1_two_studies",
    TISSUE_SQL.replace(SEVENTH, "")
    .replace("vox AS (SELECT 't1' AS v, * FROM t1 UNION ALL SELECT 'fs', * FROM fs)", f"{STUDY_SQL}, vox AS (SELECT s || ' t1' AS v, k, j, i, k * 64 + j * 8 + i AS idx, stored FROM t12 UNION ALL SELECT s || ' fs', k, j, i, k * 64 + j * 8 + i, stored FROM fs2)")
    .replace("a.idx = f.idx AND a.v = 't1' AND f.v = 'fs'", "a.idx = f.idx AND a.v[1] = f.v[1] AND a.v[3:4] = 't1' AND f.v[3:4] = 'fs'")
    .replace("tis AS (SELECT a.k", "tis AS (SELECT a.v AS volume_id, a.k")
    .join(("WITH ", " SELECT volume_id, idx, tissue, round(confidence, 6) AS confidence FROM tis")),
)
def join1_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tissue of two studies in one call; scales count every voxel."""
    t = tissue.classify(two_studies(t1_voxels(spark, sf_dir)), two_studies(fatsat_voxels(spark, sf_dir)), ["study_id"], stride=1)
    return t.select("volume_id", "idx", "tissue", F.round("confidence", 6).alias("confidence"))


def laid_out(spark: SparkSession, voxels: DataFrame, halo: int = 1, stride: int = 7) -> DataFrame:
    """Signals of two studies, each a volume of its own name, bucketed by slab; the scale counts every ``stride``-th voxel."""
    v = histogram.signals(two_studies(voxels), stride).withColumn("volume_id", F.col("study_id"))
    return layout.lay_out(slabs.spread(v, slabs.grid_of(v, SPACING), ["signal"], halo))


@query("join1_laid_out", registry_sql("join1_two_studies").replace("SELECT volume_id, idx", "SELECT volume_id[1] AS volume_id, idx"))
def join1_laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sequences of two studies, laid out by slab: their join shuffles nothing. Scales count every voxel."""
    t = tissue.classify_laid_out(*(laid_out(spark, v(spark, sf_dir), stride=1) for v in (t1_voxels, fatsat_voxels)))
    return t.select("volume_id", "idx", "tissue", F.round("confidence", 6).alias("confidence"))


@query(
    "join13_laid_out_hessian",
    f"""WITH {SCALE_SQL.replace("vox AS (SELECT 't1' AS v, * FROM t1 UNION ALL SELECT 'fs', * FROM fs)", f"{STUDY_SQL}, vox AS (SELECT s AS v, k, j, i, k * 64 + j * 8 + i AS idx, stored FROM t12)")},
n AS (SELECT v, max(k) + 1 AS nz FROM sig GROUP BY v)
SELECT c.v AS volume_id, c.idx, round(sum(CASE WHEN a.idx = c.idx THEN -6 ELSE 1 END * a.s), 9) AS laplacian FROM sig c JOIN n USING (v) JOIN sig a ON a.v = c.v AND a.idx IN (c.idx, c.idx - 1, c.idx + 1, c.idx - 8, c.idx + 8, c.idx - 64, c.idx + 64)
WHERE c.i BETWEEN 1 AND 6 AND c.j BETWEEN 1 AND 6 AND c.k BETWEEN 1 AND nz - 2 GROUP BY c.v, c.idx""",
)
def join13_laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six neighbours of every voxel of two studies, read within their slabs: the sum of the second differences."""
    rows = laid_out(spark, t1_voxels(spark, sf_dir))
    h = shape.hessian_of(rows.withColumn("plane", F.transform("plane", lambda x: F.struct(x["j"].alias("j"), x["i"].alias("i"), x["signal"].alias("value")))))
    return h.select("volume_id", "idx", F.round(F.col("xx") + F.col("yy") + F.col("zz"), 9).alias("laplacian"))
