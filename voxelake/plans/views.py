"""Queries over view rules, records of components, and the remaining predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import geometry as g
from voxelake.functions import rules, scalar, views
from voxelake.operators import graph, resample, slabs, tissue
from voxelake.plans.geometry import V_SQL, D, P, vectors
from voxelake.plans.registry import query, table
from voxelake.plans.volumes import SCALE_SQL, TISSUE_SQL, study
from voxelake.sources import grids
from voxelake.sources.grids import T1_SQL, fatsat_voxels, t1_voxels


@query("geo8_standard_planes", f"WITH {V_SQL}, q AS (SELECT vec_id, 'axial' AS plane, px AS u, py AS v, pz AS depth FROM v UNION ALL SELECT vec_id, 'coronal', px, -pz, py FROM v UNION ALL SELECT vec_id, 'sagittal', py, -pz, px FROM v) SELECT vec_id, plane, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(depth, 6) + 0.0 AS depth FROM q")
def geo8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors(spark, sf_dir).select("vec_id", F.explode(views.in_planes(P())).alias("q"))
    return q.select("vec_id", "q.plane", *((F.round(f"q.{c}", 6) + 0.0).alias(c) for c in ("u", "v", "depth")))


@query("geo11_slice_frame", f"WITH {V_SQL}, s AS (SELECT vec_id, abs(px) * 20 + 1 AS w, abs(py) * 20 + 1 AS h, 1 + y AS zoom FROM v), f AS (SELECT *, least(1.0, 1024 / greatest(w / 0.25, h / 0.25, 1.0)) AS sh, 4 / 3.0 AS asp FROM s) SELECT vec_id, CAST(greatest(floor(w / 0.25 * sh + 0.5), 1) AS BIGINT) AS width, CAST(greatest(floor(h / 0.25 * sh + 0.5), 1) AS BIGINT) AS height, round(CASE WHEN w / greatest(h, 0.000001) > asp THEN w ELSE h * asp END / zoom, 4) AS span_x, round(CASE WHEN w / greatest(h, 0.000001) > asp THEN w / asp ELSE h END / zoom, 4) AS span_y FROM f")
def geo11(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.abs(P()[0]) * 20 + 1, F.abs(P()[1]) * 20 + 1)
    w, h = views.slice_frame(size, (0.5, 0.5, 3.3), 1024)
    sx, sy = views.fit_span(size, (400, 300), 1 + D()[1])
    return vectors(spark, sf_dir).select("vec_id", w.alias("width"), h.alias("height"), F.round(sx, 4).alias("span_x"), F.round(sy, 4).alias("span_y"))


@query("geo20_screen_to_patient", f"WITH {V_SQL}, s AS (SELECT vec_id, px, py, abs(px) * 20 + 1 AS w, abs(py) * 20 + 1 AS h, 1 + abs(y) AS zoom, 4 / 3.0 AS asp FROM v), f AS (SELECT *, CASE WHEN w / greatest(h, 0.000001) > asp THEN w ELSE h * asp END / zoom AS sx, CASE WHEN w / greatest(h, 0.000001) > asp THEN w / asp ELSE h END / zoom AS sy FROM s) SELECT vec_id, round(((200 + px) / 400 - 0.5) * sx, 6) + 0.0 AS x, round(((150 + py) / 300 - 0.5) * sy, 6) + 0.0 AS y, round(sx / 400, 6) AS mm_x, round(sy / 300, 6) AS mm_y FROM f")
def geo20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pane's pixel in millimetres, and how many a pixel covers, of a plane fitted into it."""
    size, pane = (F.abs(P()[0]) * 20 + 1, F.abs(P()[1]) * 20 + 1), (400, 300)
    span = views.fit_span(size, pane, 1 + F.abs(D()[1]))
    x, y = views.to_patient(200 + P()[0], 150 + P()[1], pane, span)
    mm = views.mm_per_pixel(span, pane)
    return vectors(spark, sf_dir).select("vec_id", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"), F.round(mm[0], 6).alias("mm_x"), F.round(mm[1], 6).alias("mm_y"))


GRAY_SQL = "p AS (SELECT c * 144 + y * 12 + x AS pixel, c, x * 0.7 - 0.3 AS fx, y * 0.7 - 0.3 AS fy, c * 10.3 AS fz FROM range(0, 12) rx(x), range(0, 12) ry(y), (SELECT DISTINCT k // 11 AS c FROM t1) s)"


@query("join9_slice_gray", f"WITH {T1_SQL}, {GRAY_SQL} SELECT pixel, CAST(coalesce(floor(least(1.0, greatest(0.0, (stored - 1700) / 600.0)) * 255 + 0.5), 0) AS INTEGER) AS gray FROM p LEFT JOIN t1 ON t1.i = floor(fx + 0.5) AND t1.j = floor(fy + 0.5) AND t1.k = floor(fz + 0.5)")
def join9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 12 x 12 pixels of cuts through the grid, windowed to grey; 0 outside."""
    t1 = t1_voxels(spark, sf_dir)
    cuts = t1.select(F.floor(F.col("k") / 11).alias("c")).distinct()
    cells = F.explode(F.sequence(F.lit(0), F.lit(143)))
    p = cuts.select("c", cells.alias("n")).select((F.col("c") * 144 + F.col("n")).alias("pixel"), (F.col("n") % 12 * 0.7 - 0.3).alias("x"), (F.floor(F.col("n") / 12) * 0.7 - 0.3).alias("y"), (F.col("c") * 10.3).alias("z"))
    read = resample.nearest(p.join(grids.dims(t1)), t1)
    gray = scalar.half_up(scalar.window_level(F.col("stored"), 2000, 600) * 255)
    return read.select("pixel", F.coalesce(gray, F.lit(0)).cast("int").alias("gray"))


@query("join12_shade", f"WITH {TISSUE_SQL}, l AS (SELECT idx, 'tendon' AS label, idx % 3 AS conf FROM tis WHERE idx % 5 = 0) SELECT CASE WHEN conf > 0 THEN label ELSE tissue END AS shade, count(*) AS n FROM tis LEFT JOIN l USING (idx) GROUP BY 1")
def join12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structure's label wins over the tissue where it has confidence."""
    t = tissue.classify(t1_voxels(spark, sf_dir), fatsat_voxels(spark, sf_dir))
    labels = t.filter(F.col("idx") % 5 == 0).select("idx", F.lit("tendon").alias("label"), (F.col("idx") % 3).alias("conf"))
    return t.join(labels, "idx", "left").groupBy(F.when(F.col("conf") > 0, F.col("label")).otherwise(F.col("tissue")).alias("shade")).agg(F.count("*").alias("n"))


#: Points between the voxels of a grid of half the slices, as seen in both sequences.
GRID_SQL = "gp AS (SELECT idx, i + 0.25 AS px, j * 0.9 + 0.5 AS py, k * 2.0 - 0.25 AS pz FROM t1 WHERE k < (SELECT (max(k) + 1) / 2.0 FROM t1)), seen AS (SELECT idx, 't1' AS v, px AS x, py AS y, pz AS z FROM gp UNION ALL SELECT idx, 'fs', px - 0.5, py - 0.25, (pz - 1) / 1.25 FROM gp)"
READ_SQL = """lim AS (SELECT seen.*, n FROM seen, (SELECT max(k) + 1 AS n FROM t1) d WHERE x >= -0.5 AND y >= -0.5 AND z >= -0.5 AND x <= 7.5 AND y <= 7.5 AND z <= n - 0.5),
cl AS (SELECT idx, v, least(greatest(x, 0.0), 7.0) AS x, least(greatest(y, 0.0), 7.0) AS y, least(greatest(z, 0.0), n - 1.0) AS z, n FROM lim),
cr AS (SELECT idx, v, (least(floor(z) + c, n - 1) * 64 + least(floor(y) + b, 7) * 8 + least(floor(x) + a, 7)) AS at, abs(1 - a - (x - floor(x))) * abs(1 - b - (y - floor(y))) * abs(1 - c - (z - floor(z))) AS w FROM cl, range(2) ra(a), range(2) rb(b), range(2) rc(c)),
rd AS (SELECT cr.idx, cr.v, sum(w * s) AS s FROM cr JOIN sig ON sig.v = cr.v AND sig.idx = cr.at GROUP BY 1, 2),
pairs AS (SELECT gp.idx, a.s AS t1, f.s AS fs FROM gp LEFT JOIN rd a ON a.idx = gp.idx AND a.v = 't1' LEFT JOIN rd f ON f.idx = gp.idx AND f.v = 'fs')"""
ALONE_SQL = f"CASE WHEN fs IS NOT NULL THEN CASE WHEN fs < {rules.FATSAT.noise!r} THEN 'background' WHEN fs >= {rules.FATSAT.high!r} THEN 'fluid' WHEN fs >= {rules.FATSAT.low!r} THEN 'muscle' ELSE 'dark' END WHEN t1 IS NOT NULL THEN CASE WHEN t1 < {rules.T1.noise!r} THEN 'background' WHEN t1 >= {rules.T1.high!r} THEN 'fat' WHEN t1 >= {rules.T1.low!r} THEN 'muscle' ELSE 'dark' END ELSE 'unknown' END"


@query("join3_classify_grid", f"WITH {SCALE_SQL}, {GRID_SQL}, {READ_SQL} SELECT idx, round(t1, 6) AS t1, round(fs, 6) AS fs, CASE WHEN t1 IS NOT NULL AND fs IS NOT NULL THEN {rules.sql_pair('t1', 'fs')[0]} ELSE {ALONE_SQL} END AS tissue FROM pairs")
def join3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tissue at a grid's own points: both sequences read there through patient space."""
    t1, fs, of = t1_voxels(spark, sf_dir), fatsat_voxels(spark, sf_dir), study(spark, sf_dir)
    half = grids.dims(t1).select(((F.col("nz")) / 2.0).alias("half"))
    points = t1.join(F.broadcast(half), F.col("k") < F.col("half")).select("idx", (F.col("i") + 0.25).alias("px"), (F.col("j") * 0.9 + 0.5).alias("py"), (F.col("k") * 2.0 - 0.25).alias("pz"))
    got = tissue.classify_grid(points.withColumnRenamed("idx", "of"), {"t1": (t1, of.filter("volume_id = 't1'")), "fs": (fs, of.filter("volume_id = 'fs'"))}, ["of"])
    return got.select(F.col("of").alias("idx"), F.round("t1", 6).alias("t1"), F.round("fs", 6).alias("fs"), "tissue")


@query("flt2_same_frame", "SELECT l_orderkey, l_linenumber, l_partkey % 4 > 0 AND l_suppkey % 4 > 0 AND l_partkey % 97 = l_suppkey % 97 AS same FROM lineitem")
def flt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal frames of reference; a missing one equals nothing, not even itself."""
    frame = lambda k: F.when(F.col(k) % 4 == 0, "").otherwise((F.col(k) % 97).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", views.same_frame(frame("l_partkey"), frame("l_suppkey")).alias("same"))


@query("flt5_outside_volume", f"WITH {V_SQL} SELECT vec_id, px < -20 OR px > 15 OR py < -10 OR py > 25 OR pz < -30 OR pz > 12.5 AS outside FROM v")
def flt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", views.outside(P(), (-20.0, -10.0, -30.0), (15.0, 25.0, 12.5)).alias("outside"))


@query("geo16_ray_box", f"WITH {V_SQL}, r AS (SELECT vec_id, (-0.5 - px) / x AS a0, (7.5 - px) / x AS b0, (-0.5 - py) / y AS a1, (7.5 - py) / y AS b1, (-0.5 - pz) / z AS a2, (9.5 - pz) / z AS b2 FROM v WHERE x <> 0 AND y <> 0 AND z <> 0), t AS (SELECT vec_id, greatest(least(a0, b0), least(a1, b1), least(a2, b2)) AS near, least(greatest(a0, b0), greatest(a1, b1), greatest(a2, b2)) AS far FROM r) SELECT vec_id, far > greatest(near, 0) AS hit, round(near, 4) AS near, round(far, 4) AS far FROM t")
def geo16_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a ray is within a grid's box, half a voxel around its centres."""
    hit, near, far = views.ray_box(P(), D(), (8, 8, 10))
    return vectors(spark, sf_dir).filter("x <> 0 and y <> 0 and z <> 0").select("vec_id", hit.alias("hit"), F.round(near, 4).alias("near"), F.round(far, 4).alias("far"))


@query("geo23_cube_viewport", f"WITH {V_SQL}, p AS (SELECT vec_id, floor(abs(px)) AS x, floor(abs(py)) AS y, floor(abs(pz) * 20) + 1 AS w, floor(abs(px) * 10) + 1 AS h FROM v), s AS (SELECT *, least(132, floor(least(w, h) * 0.4)) AS size FROM p) SELECT vec_id, CAST(x + w - size - 12 AS BIGINT) AS x, CAST(y + 12 AS BIGINT) AS y, CAST(size AS BIGINT) AS size FROM s")
def geo23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the orientation cube sits in its pane."""
    px, py, pz = map(F.abs, P())
    x, y, size = views.cube_viewport(F.floor(px), F.floor(py), F.floor(pz * 20) + 1, F.floor(px * 10) + 1)
    return vectors(spark, sf_dir).select("vec_id", *(c.cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (size, "size"))))


@query("flt4_on_cut", "SELECT event_id, abs(value - 50) <= 1.65 + 0.000000001 AS on_cut FROM events")
def flt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.abs(F.col("value") - 50) <= 1.65 + 1e-9).alias("on_cut"))


MASKED = [(0x6000, 0x0010, 0xFF00, 0xFFFF), (0x0028, 0x0000, 0xFFFF, 0xFF00)]


@query("flt10_masked_tags", "WITH t AS (SELECT p_partkey, 24576 + p_partkey % 512 AS g, CASE WHEN p_size % 2 = 0 THEN 16 ELSE p_size END AS e FROM part UNION ALL SELECT p_partkey + 1000000, 40, p_size * 20 FROM part) SELECT p_partkey FROM t WHERE ((g & 65280) = 24576 AND (e & 65535) = 16) OR ((g & 65535) = 40 AND (e & 65280) = 0)")
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that match a masked pattern; the patterns are a profile's few fixed ones."""
    p = table(spark, sf_dir, "part")
    t = p.select("p_partkey", (24576 + F.col("p_partkey") % 512).alias("g"), F.when(F.col("p_size") % 2 == 0, 16).otherwise(F.col("p_size")).alias("e"))
    t = t.union(p.select(F.col("p_partkey") + 1_000_000, F.lit(40).cast("long"), F.col("p_size") * 20))
    hit = F.lit(False)
    for wg, we, gm, em in MASKED:
        hit = hit | ((F.col("g").bitwiseAND(F.lit(gm)) == wg) & (F.col("e").bitwiseAND(F.lit(em)) == we))
    return t.filter(hit).select("p_partkey")


@query("flt11_finite", f"WITH {V_SQL} SELECT vec_id, NOT (isnan(q) OR isinf(q)) AS finite FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN x WHEN 1 THEN CAST('nan' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS q FROM v)")
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("vec_id") % 3 == 0, F.col("x")).when(F.col("vec_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return vectors(spark, sf_dir).select("vec_id", g.is_finite((x, F.col("y"), F.col("z"))).alias("finite"))


EV_SQL = """ev AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'sheet' WHEN 1 THEN 'blob' ELSE 'tube' END AS kind, p_size AS voxels, 0.5 + (p_partkey % 50) / 100.0 AS agreement, 0.3 + (p_partkey % 7) / 10.0 AS sc,
(p_partkey % 11) / 60.0 AS marrow, (p_partkey % 13) / 20.0 AS muscle, (p_partkey % 17) / 25.0 AS fat, (p_partkey % 40) * 1.0 AS len, (p_partkey % 5) / 20.0 AS m0, (p_partkey % 3) / 10.0 AS u0, (p_partkey % 7) / 25.0 AS m2, (p_partkey % 2) / 5.0 AS u2 FROM part)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cols = {"kind": F.when(k % 4 == 0, "sheet").when(k % 4 == 1, "blob").otherwise("tube"), "voxels": F.col("p_size"), "agreement": 0.5 + (k % 50) / 100.0, "shape_confidence": 0.3 + (k % 7) / 10.0, "marrow": (k % 11) / 60.0, "muscle": (k % 13) / 20.0, "fat": (k % 17) / 25.0, "length_mm": (k % 40) * 1.0, "marrow0": (k % 5) / 20.0, "muscle0": (k % 3) / 10.0, "marrow2": (k % 7) / 25.0, "muscle2": (k % 2) / 5.0}
    return table(spark, sf_dir, "part").select(k.alias("id"), *(c.alias(n) for n, c in cols.items()))


PAST = "least(1.0, greatest(0.0, ({0} - {1}) / {2}))"
NAME_SQL = f"""WITH {EV_SQL}, r AS (SELECT *, CASE WHEN voxels < 12 OR kind = 'blob' OR agreement < 0.55 THEN 'dark' WHEN kind = 'sheet' THEN CASE WHEN marrow < 0.04 THEN 'dark' ELSE 'cortex' END
WHEN m0 >= 0.06 AND m2 >= 0.06 AND u0 < 0.1 AND u2 < 0.1 THEN 'ligament' WHEN (u0 >= 0.1 AND m2 >= 0.06) OR (u2 >= 0.1 AND m0 >= 0.06) THEN 'tendon' WHEN m0 < 0.06 AND m2 < 0.06 AND len >= 15 AND fat + muscle >= 0.5 THEN 'vessel' ELSE 'dark' END AS s FROM ev),
c AS (SELECT id, s, CASE WHEN voxels < 12 THEN 'few_voxels' WHEN kind = 'none' THEN 'no_shape' WHEN kind = 'blob' THEN 'blob' WHEN agreement < 0.55 THEN 'surroundings_disagree' WHEN kind = 'sheet' THEN CASE WHEN marrow < 0.04 THEN 'sheet_without_marrow' ELSE 'sheet_on_marrow' END
WHEN s = 'ligament' THEN 'bone_to_bone' WHEN s = 'tendon' THEN 'muscle_to_bone' WHEN s = 'vessel' THEN 'long_in_soft_tissue' ELSE 'ends_undecided' END AS why, least(1.0, agreement * sc * CASE s WHEN 'cortex' THEN {PAST.format('marrow', 0.04, 0.1)} WHEN 'ligament' THEN {PAST.format('least(m0, m2)', 0.06, 0.1)} WHEN 'tendon' THEN {PAST.format('greatest(u0, u2)', 0.1, 0.2)} WHEN 'vessel' THEN {PAST.format('(fat + muscle)', 0.5, 0.3)} ELSE 0 END) AS c FROM r)
SELECT id, CASE WHEN c < 0.15 THEN 'dark' ELSE s END AS structure, round(CASE WHEN c < 0.15 THEN 0 ELSE c END, 6) AS confidence, CASE WHEN s <> 'dark' THEN why || CASE WHEN c < 0.15 THEN '_unsure' ELSE '' END ELSE why END AS reason FROM c"""


@query("rul7_name_component", NAME_SQL)
def rul7(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, why = rules.name_component(graph.evidence_columns())
    return evidence(spark, sf_dir).select("id", s.alias("structure"), F.round(c, 6).alias("confidence"), why.alias("reason"))


@query("rul9_voxel_fade", f"WITH {EV_SQL} SELECT id, CAST(floor(least(1.0, sc * (0.6 + 0.4 * least(1.0, marrow / 0.25))) * 255 + 0.5) AS BIGINT) AS level FROM ev")
def rul9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("id", rules.fade(F.col("shape_confidence"), F.col("marrow")).alias("level"))


@query("rul10_model_plan", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN CASE WHEN c_acctbal >= 3000 THEN 'large' ELSE 'small' END WHEN NOT (c_nationkey % 3 = 0) THEN 'slim' END AS plan FROM customer")
def rul10(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", views.model_plan(n % 2 == 0, F.col("c_acctbal"), n % 3 == 0, 3000).alias("plan"))


@query("rul12_view_limits", "SELECT l_suppkey, round(lo - greatest(hi - lo, 1) * 0.1, 4) AS least_center, round(hi + greatest(hi - lo, 1) * 0.1, 4) AS most_center, round(greatest(hi - lo, 1) * 1.5, 4) AS most_width FROM (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)")
def rul12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    a, b, c = views.window_limits(F.col("lo"), F.col("hi"))
    return r.select("l_suppkey", F.round(a, 4).alias("least_center"), F.round(b, 4).alias("most_center"), F.round(c, 4).alias("most_width"))


@query("rul13_display", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0 ELSE value END, 40.0) AS width FROM events")
def rul13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting that is absent takes the default; 0 is a setting."""
    given = F.when(F.col("event_id") % 3 == 1, 0.0).when(F.col("event_id") % 3 == 2, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(given, F.lit(40.0)).alias("width"))


@query("rul14_gesture", "SELECT event_id, CASE WHEN event_id % 3 = 2 OR event_id % 5 = 0 THEN 'window' WHEN event_id % 3 = 1 OR event_id % 7 = 0 THEN 'pan' WHEN event_type = 'view' THEN 'orbit' ELSE 'crosshair' END AS gesture FROM events")
def rul14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", views.gesture(e % 3, e % 5 == 0, e % 7 == 0, F.col("event_type") == "view").alias("gesture"))


@query("fn_tutorial_paging", "SELECT p_partkey, CAST(least(p_size + 1, 39) AS INTEGER) AS next, p_size + 1 >= 40 AS finished, CAST(greatest(0, p_size - 1) AS INTEGER) AS previous, 39 AS skipped, CAST(least(greatest(p_size - 5, 0), 39) AS INTEGER) AS shown, CAST(p_size - 5 + 1 AS INTEGER) AS current FROM part")
def fn_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt, done = views.next_step(F.col("p_size"), 40)
    shown, current = views.step_shown(F.col("p_size") - 5, 40)
    return table(spark, sf_dir, "part").select("p_partkey", nxt.alias("next"), done.alias("finished"), views.previous_step(F.col("p_size")).alias("previous"), F.lit(39).alias("skipped"), shown.alias("shown"), current.alias("current"))


SAVED_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"step": ' || CAST(event_id % 40 AS VARCHAR) || ', "finished": true}' WHEN 1 THEN '{"step": "three", "finished": "yes"}' WHEN 2 THEN '[1, 2' WHEN 3 THEN NULL WHEN 4 THEN '17' ELSE '{"finished": true}' END AS raw FROM events"""


@query("fn_saved_state", f"WITH r AS ({SAVED_SQL}) SELECT event_id, CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 40 AS DOUBLE) ELSE 0.0 END AS step, event_id % 6 IN (0, 5) AS finished FROM r")
def fn_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved state read with tolerance: what cannot be read is a first visit."""
    e = F.col("event_id")
    raw = F.when(e % 6 == 0, F.concat(F.lit('{"step": '), (e % 40).cast("string"), F.lit(', "finished": true}'))).when(e % 6 == 1, '{"step": "three", "finished": "yes"}').when(e % 6 == 2, "[1, 2").when(e % 6 == 4, "17").when(e % 6 == 5, '{"finished": true}')
    step, finished = views.saved_step(raw)
    return table(spark, sf_dir, "events").select("event_id", step.alias("step"), finished.alias("finished"))


@query("agg5_median", "SELECT l_suppkey, median(l_extendedprice) AS median, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.median("l_extendedprice").alias("median"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("agg21_heat_peak", "SELECT vec_id, round(list_max(embedding), 6) AS peak, round(1 / (1 + exp(-list_max(CAST(embedding AS DOUBLE[])))), 6) AS sigmoid FROM embeddings".replace("round(list_max(embedding), 6)", "round(list_max(CAST(embedding AS DOUBLE[])), 6)"))
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.array_max(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(top, 6).alias("peak"), F.round(1 / (1 + F.exp(-top)), 6).alias("sigmoid"))


@query("grf4_ends", f"WITH {T1_SQL}, gr AS (SELECT *, k // 8 AS comp FROM t1 WHERE stored < 1800), c AS (SELECT comp, avg(i) AS ci, avg(j) AS cj, avg(k) AS ck FROM gr GROUP BY 1), d AS (SELECT gr.*, i - ci AS x, j - cj AS y, k - ck AS z, (i - ci) * (i - ci) + (j - cj) * (j - cj) + (k - ck) * (k - ck) AS d2 FROM gr JOIN c USING (comp)), t AS (SELECT comp, x AS ax, y AS ay, z AS az FROM d QUALIFY row_number() OVER (PARTITION BY comp ORDER BY d2 DESC, idx) = 1), a AS (SELECT d.*, (x * ax + y * ay + z * az) / CASE WHEN ax * ax + ay * ay + az * az = 0 THEN 1 ELSE sqrt(ax * ax + ay * ay + az * az) END AS along FROM d JOIN t USING (comp)), s AS (SELECT comp, min(along) AS low, max(along) AS high FROM a GROUP BY 1) SELECT CAST(comp AS BIGINT) AS component_id, count(*) AS voxels, round(any_value(high - low), 6) AS length_mm, count(*) FILTER (WHERE along <= low + (high - low) * 0.3) AS at_start, count(*) FILTER (WHERE along > low + (high - low) * 0.3 AND along >= high - (high - low) * 0.3) AS at_end FROM a JOIN s USING (comp) GROUP BY comp")
def grf4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length along the long axis of dark voxels and the voxels at its ends, by groups of eight slices."""
    v = t1_voxels(spark, sf_dir)
    d = v.filter("stored < 1800").select("volume_id", F.floor(F.col("k") / 8).alias("component_id"), "idx", "k", "j", "i", F.lit("tube").alias("kind"), F.lit(1.0).alias("confidence"))
    e = graph.split_ends(d, slabs.grid_of(v))
    return e.groupBy("component_id").agg(F.count("*").alias("voxels"), F.round(F.first("length_mm"), 6).alias("length_mm"), F.count_if(F.col("bucket") == 0).alias("at_start"), F.count_if(F.col("bucket") == 2).alias("at_end"))
