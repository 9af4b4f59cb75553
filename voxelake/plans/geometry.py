"""Queries over patient-space geometry; directions and points are read from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import geometry as g
from voxelake.functions import rules, scalar
from voxelake.operators import series, walk
from voxelake.plans.registry import query, table

# d: a direction (x, y, z), p: a point in mm (px, py, pz)
V_SQL = "v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) * 100 AS px, CAST(embedding[5] AS DOUBLE) * 100 AS py, CAST(embedding[6] AS DOUBLE) * 100 AS pz FROM embeddings), u AS (SELECT *, x / sqrt(x * x + y * y + z * z) AS ux, y / sqrt(x * x + y * y + z * z) AS uy, z / sqrt(x * x + y * y + z * z) AS uz FROM v)"


def D() -> g.Vec:
    """The direction of a row."""
    return tuple(map(F.col, "xyz"))


def P() -> g.Vec:
    """The point of a row, in mm."""
    return tuple(F.col("p" + c) for c in "xyz")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: F.get("embedding", F.lit(n)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", *(at(n).alias(c) for n, c in enumerate("xyz")), *((at(3 + n) * 100).alias("p" + c) for n, c in enumerate("xyz")))


def r6(c, name: str):
    return (F.round(c, 6) + 0.0).alias(name)


@query("geo1_vectors", f"WITH {V_SQL} SELECT vec_id, round(x * px + y * py + z * pz, 6) + 0.0 AS dot, round(y * pz - z * py, 6) + 0.0 AS cx, round(z * px - x * pz, 6) + 0.0 AS cy, round(x * py - y * px, 6) + 0.0 AS cz, round(sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2), 6) AS dist, round(ux, 6) + 0.0 AS ux FROM u")
def geo1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = g.cross(D(), P())
    return vectors(spark, sf_dir).select("vec_id", r6(g.dot(D(), P()), "dot"), *(r6(v, n) for v, n in zip(c, ("cx", "cy", "cz"), strict=True)), r6(g.distance(D(), P()), "dist"), r6(g.normalize(D())[0], "ux"))


# an affine of each row: axes along the direction's permutations, origin at the point
M = ("x", "y", "z", "px", "z", "x", "y", "py", "y", "z", "x", "pz")


@query("geo2_affine_roundtrip", f"WITH {V_SQL} SELECT vec_id, round(x * 1 + y * 2 + z * 3 + px, 6) + 0.0 AS ax, round(z * 1 + x * 2 + y * 3 + py, 6) + 0.0 AS ay, round(y * 1 + z * 2 + x * 3 + pz, 6) + 0.0 AS az, true AS back FROM v")
def geo2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voxel to the patient and back again."""
    m = tuple(F.col(c) for c in M)
    there = g.apply_affine(m, (1, 2, 3))
    back = g.apply_affine(g.invert_affine(m), there)
    ok = F.lit(True)
    for v, n in zip(back, (1, 2, 3), strict=True):
        ok = ok & (F.abs(v - n) < 1e-3)
    return vectors(spark, sf_dir).select("vec_id", *(r6(v, n) for v, n in zip(there, ("ax", "ay", "az"), strict=True)), ok.alias("back"))


BEST = "greatest(abs(ux), abs(uy), abs(uz))"


@query("geo3_nearest_axis", f"WITH {V_SQL} SELECT vec_id, CASE WHEN -ux = {BEST} THEN 'R' WHEN ux = {BEST} THEN 'L' WHEN -uy = {BEST} THEN 'A' WHEN uy = {BEST} THEN 'P' WHEN -uz = {BEST} THEN 'I' ELSE 'S' END AS code FROM u")
def geo3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", g.nearest_axis(D()).alias("code"))


def direction_sql(x: str, y: str, z: str) -> str:
    items = ", ".join(f"{{'s': {s}, 'n': {n}, 'c': '{c}'}}" for n, (c, s) in enumerate((("R", x), ("L", f"-({x})"), ("A", y), ("P", f"-({y})"), ("I", z), ("S", f"-({z})"))))
    kept = f"list_sort([q FOR q IN [{items}] IF q.s < 0])"
    return f"array_to_string([q.c FOR q IN {kept} IF q.s <= list_min([w.s FOR w IN {kept}]) * 0.5], '')"


@query("geo4_direction_label", f"WITH {V_SQL} SELECT vec_id, {direction_sql('ux', 'uy', 'uz')} AS label FROM u")
def geo4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", g.describe_direction(D()).alias("label"))


PLANE = "CASE WHEN abs(uz) >= 0.7 THEN 'axial' WHEN abs(uy) >= 0.7 THEN 'coronal' WHEN abs(ux) >= 0.7 THEN 'sagittal' ELSE 'oblique' END"


@query("geo5_plane_name", f"WITH {V_SQL} SELECT vec_id, {PLANE} AS plane FROM u")
def geo5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", g.describe_plane(D(), 0.7).alias("plane"))


@query("geo6_edge_labels", f"WITH {V_SQL}, n AS (SELECT vec_id, ux, uy, uz, py * uz - pz * uy AS cx, pz * ux - px * uz AS cy, px * uy - py * ux AS cz FROM u) SELECT vec_id, {direction_sql('-cx', '-cy', '-cz')} AS top, {direction_sql('cx', 'cy', 'cz')} AS bottom, {direction_sql('-ux', '-uy', '-uz')} AS left, {direction_sql('ux', 'uy', 'uz')} AS right FROM n".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def geo6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # staged, so that the labels share the cross product instead of repeating it
    n = vectors(spark, sf_dir).select("vec_id", *P(), *(c.alias("u" + x) for c, x in zip(g.normalize(D()), "xyz", strict=True)))
    u = tuple(F.col("u" + x) for x in "xyz")
    n = n.select("vec_id", *u, *(c.alias("c" + x) for c, x in zip(g.cross(P(), u), "xyz", strict=True)))
    e = g.edge_labels(u, tuple(F.col("c" + x) for x in "xyz"))
    return n.select("vec_id", *(c.alias(k) for k, c in e.items()))


CORNERS = "(SELECT a, b, c FROM (VALUES (-0.5), (7.5)) ra(a), (VALUES (-0.5), (7.5)) rb(b), (VALUES (-0.5), (3.5)) rc(c))"


@query("geo7_patient_bounds", f"WITH {V_SQL}, q AS (SELECT vec_id, x * a + y * b + z * c + px AS x, z * a + x * b + y * c + py AS y, y * a + z * b + x * c + pz AS z FROM v, {CORNERS}) SELECT vec_id, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, round(min(z), 6) AS z0, round(max(z), 6) AS z1 FROM q GROUP BY vec_id")
def geo7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around an 8 x 8 x 4 grid's corners, all eight in one row."""
    m = tuple(F.col(c) for c in M)
    corners = [g.apply_affine(m, (a, b, c)) for a in (-0.5, 7.5) for b in (-0.5, 7.5) for c in (-0.5, 3.5)]
    cols = [f(*(c[n] for c in corners)) for n in range(3) for f in (F.least, F.greatest)]
    return vectors(spark, sf_dir).select("vec_id", *(F.round(c, 6).alias(n) for c, n in zip(cols, ("x0", "x1", "y0", "y1", "z0", "z1"), strict=True)))


@query("geo9_clamp_cursor", f"WITH {V_SQL} SELECT vec_id, round(least(10.0, greatest(-10.0, px)), 6) AS x, round(least(10.0, greatest(-10.0, py)), 6) AS y, round(least(5.0, greatest(-5.0, pz)), 6) AS z, px < -10 OR px > 10 OR py < -10 OR py > 10 OR pz < -5 OR pz > 5 AS outside FROM v")
def geo9(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = ((-10.0, 10.0), (-10.0, 10.0), (-5.0, 5.0))
    out = F.lit(False)
    for p, (a, b) in zip(P(), box, strict=True):
        out = out | ~p.between(a, b)
    return vectors(spark, sf_dir).select("vec_id", *(F.round(scalar.clamp(p, a, b), 6).alias(n) for p, (a, b), n in zip(P(), box, "xyz", strict=True)), out.alias("outside"))


@query("geo12_frame_roundtrip", f"WITH {V_SQL}, f AS (SELECT vec_id, 64 + px / 0.5 - 0.5 AS fx, 48 + py / 0.5 - 0.5 AS fy FROM v) SELECT vec_id, round(fx, 6) AS fx, round(fy, 6) AS fy, true AS back FROM f")
def geo12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patient point on a 128 x 96 frame of 0.5 mm pixels around the origin, and back."""
    fx, fy = 64 + P()[0] / 0.5 - 0.5, 48 + P()[1] / 0.5 - 0.5
    bx, by = (F.col("fx") + 0.5 - 64) * 0.5, (F.col("fy") + 0.5 - 48) * 0.5
    f = vectors(spark, sf_dir).withColumn("fx", fx).withColumn("fy", fy)
    return f.select("vec_id", F.round("fx", 6).alias("fx"), F.round("fy", 6).alias("fy"), ((F.abs(bx - P()[0]) < 1e-6) & (F.abs(by - P()[1]) < 1e-6)).alias("back"))


@query("geo13_voxel_extent", f"WITH {V_SQL} SELECT vec_id, round(abs(ux) * 0.5 + abs(uy) * 0.5 + abs(uz) * 3.3, 6) AS extent FROM u")
def geo13(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = g.normalize(D())
    return vectors(spark, sf_dir).select("vec_id", F.round(F.abs(u[0]) * 0.5 + F.abs(u[1]) * 0.5 + F.abs(u[2]) * 3.3, 6).alias("extent"))


@query("geo14_cut_depth", f"WITH {V_SQL} SELECT vec_id, round(px * ux + py * uy + pz * uz, 6) + 0.0 AS depth, CAST(floor((px * ux + py * uy + pz * uz) / 3.3 + 0.5) AS BIGINT) AS cut FROM u")
def geo14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = g.dot(P(), g.normalize(D()))
    return vectors(spark, sf_dir).select("vec_id", r6(d, "depth"), scalar.half_up(d / 3.3).alias("cut"))


@query("geo22_cube_region", "WITH " + V_SQL + ", r AS (SELECT vec_id, x / m AS x, y / m AS y, z / m AS z FROM (SELECT *, greatest(abs(x), abs(y), abs(z)) AS m FROM v)) SELECT rx * 9 + ry * 3 + rz + 13 AS region, count(*) AS n FROM (SELECT " + ", ".join(f"CAST(CASE WHEN {c} > 0.34 THEN 1 WHEN {c} < -0.34 THEN -1 ELSE 0 END AS INTEGER) AS r{c}" for c in "xyz") + " FROM r) GROUP BY 1")
def geo22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many directions face each of the view cube's 26 regions."""
    m = F.greatest(*(F.abs(c) for c in D()))
    step = lambda c: F.when(c / m > 0.34, 1).when(c / m < -0.34, -1).otherwise(0)
    return vectors(spark, sf_dir).select((step(D()[0]) * 9 + step(D()[1]) * 3 + step(D()[2]) + 13).alias("region")).groupBy("region").agg(F.count("*").alias("n"))


@query("geo15_cube_facing", f"WITH {V_SQL}, c AS (SELECT a, b, c, abs(a) + abs(b) + abs(c) AS n FROM range(-1, 2) ra(a), range(-1, 2) rb(b), range(-1, 2) rc(c) WHERE NOT (a = 0 AND b = 0 AND c = 0)), s AS (SELECT vec_id, a, b, c, round((ux * a + uy * b + uz * c) / sqrt(n) + CASE n WHEN 1 THEN 0.06 WHEN 2 THEN 0.03 ELSE 0 END, 9) AS score FROM u, c) SELECT vec_id, a * 9 + b * 3 + c + 13 AS region FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, a, b, c) = 1")
def geo15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region that faces each direction most, faces and edges a little preferred."""
    u = g.normalize(D())
    cells = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    bias = {1: 0.06, 2: 0.03, 3: 0.0}
    scores = F.array(*(F.struct((-F.round(g.dot(u, v) / (sum(map(abs, v)) ** 0.5) + bias[sum(map(abs, v))], 9)).alias("s"), F.lit(n).alias("n"), F.lit(v[0] * 9 + v[1] * 3 + v[2] + 13).cast("long").alias("region")) for n, v in enumerate(cells)))
    return vectors(spark, sf_dir).select("vec_id", F.array_min(scores)["region"].alias("region"))


PANES = [(0, 0, 0, 400, 300), (1, 400, 0, 400, 300), (2, 0, 300, 400, 300), (3, 400, 300, 400, 300)]


@query("geo19_pane_at", f"WITH {V_SQL}, q AS (SELECT vec_id, 400 + px * 20 AS sx, 300 + py * 20 AS sy FROM v), p(pane, x0, y0, w, h) AS (VALUES {', '.join(map(str, PANES))}) SELECT q.vec_id, p.pane FROM q LEFT JOIN p ON sx >= x0 AND sx < x0 + w AND sy >= y0 AND sy < y0 + h")
def geo19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of four panes that holds a screen point; none outside. Four cases, no join."""
    sx, sy = 400 + P()[0] * 20, 300 + P()[1] * 20
    pane = F.lit(None).cast("int")
    for n, x, y, w, h in reversed(PANES):
        pane = F.when((sx >= x) & (sx < x + w) & (sy >= y) & (sy < y + h), n).otherwise(pane)
    return vectors(spark, sf_dir).select("vec_id", pane.alias("pane"))


@query("geo21_wheel_step", f"WITH {V_SQL} SELECT vec_id, round(least(8.0, greatest(-8.0, px + uz * sign(x) * 0.5)), 6) AS x, round(least(6.0, greatest(0.6, 1 + y * 4)), 6) AS zoom FROM u")
def geo21(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = g.normalize(D())
    return vectors(spark, sf_dir).select("vec_id", F.round(scalar.clamp(P()[0] + u[2] * F.signum(D()[0]) * 0.5, -8.0, 8.0), 6).alias("x"), F.round(scalar.clamp(1 + D()[1] * 4, 0.6, 6.0), 6).alias("zoom"))


@query("geo16_compositing", "WITH s AS (SELECT vec_id, p, greatest(0.0, CAST(embedding[p] AS DOUBLE)) AS a FROM embeddings, range(1, 65) r(p)), t AS (SELECT vec_id, p, a, coalesce(exp(sum(ln(1 - a)) OVER (PARTITION BY vec_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS clear FROM s) SELECT vec_id, round(sum(a * clear) FILTER (WHERE 1 - clear <= 0.995), 5) AS alpha FROM t GROUP BY vec_id")
def geo16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front-to-back opacity of 64 samples a ray, stopping when nearly opaque."""
    step = lambda acc, x: F.when(acc > 0.995, acc).otherwise(acc + (1 - acc) * F.greatest(F.lit(0.0), x))
    rays = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rays.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), step), 5).alias("alpha"))


@query("flt3_different_angle", f"WITH {V_SQL} SELECT a.vec_id, abs(a.ux * b.ux + a.uy * b.uy + a.uz * b.uz) < 0.9 AS apart FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")
def flt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), *(F.col(c).alias("o" + c) for c in "xyz"))
    return v.join(n, "vec_id").select("vec_id", (F.abs(g.dot(g.normalize(D()), g.normalize(tuple(F.col("o" + c) for c in "xyz")))) < 0.9).alias("apart"))


@query("flt7_inside_grid", f"WITH {V_SQL} SELECT vec_id, px + 4 >= -0.5 AND px + 4 <= 7.5 AND py + 4 >= -0.5 AND py + 4 <= 7.5 AND pz >= -0.5 AND pz <= 3.5 AS inside, px + 4 >= 0 AND px + 4 <= 7 AND py + 4 >= 0 AND py + 4 <= 7 AND pz >= -0.5 AND pz <= 3.5 AS fusable FROM v")
def flt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, n = (P()[0] + 4, P()[1] + 4, P()[2]), (8, 8, 4)
    return vectors(spark, sf_dir).select("vec_id", g.inside(at, n).alias("inside"), g.inside_for_fusion(at, n).alias("fusable"))


CUTS = [(1.0, 0.0, 0.0, -2.0), (0.0, 0.6, 0.8, -4.0)]


@query("flt8_clipped", f"WITH {V_SQL} SELECT vec_id FROM v WHERE px - 2 > 0 OR 0.6 * py + 0.8 * pz - 4 > 0")
def flt8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter(g.clipped(P(), CUTS)).select("vec_id")


@query("flt9_overlaps", f"WITH {V_SQL}, l AS (SELECT (i + 0.5) / 512 * 7 AS x, ((i * 7) % 512) / 512.0 * 7 AS y, ((i * 13) % 512) / 512.0 * 3 AS z FROM range(512) r(i)), h AS (SELECT vec_id, count(*) FILTER (WHERE l.x + px >= -0.5 AND l.x + px <= 7.5 AND l.y + py >= -0.5 AND l.y + py <= 7.5 AND l.z + pz >= -0.5 AND l.z + pz <= 3.5) AS hits FROM v, l GROUP BY vec_id) SELECT vec_id, hits, hits > 512 / 20.0 AS overlaps FROM h")
def flt9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a grid moved by each point still covers part of the unmoved one, on 512 fixed lattice points."""
    covered = F.filter(F.sequence(F.lit(0), F.lit(511)), lambda i: g.inside(((i + 0.5) / 512 * 7 + P()[0], (i * 7 % 512) / 512.0 * 7 + P()[1], (i * 13 % 512) / 512.0 * 3 + P()[2]), (8, 8, 4)))
    hits = F.size(covered).cast("long")
    return vectors(spark, sf_dir).select("vec_id", hits.alias("hits")).withColumn("overlaps", F.col("hits") > 512 / 20)


@query("rul15_prompt_opacity", f"WITH {V_SQL} SELECT vec_id, round(CASE WHEN abs(px) <= 1.65 THEN 1.0 WHEN abs(px) >= 20 THEN 0.0 ELSE 1 - (abs(px) - 1.65) / (20 - 1.65) END, 6) AS opacity FROM v")
def rul15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(rules.prompt_opacity(P()[0], 3.3), 6).alias("opacity"))


@query("win1_depths", f"WITH {V_SQL}, d AS (SELECT vec_id, unnest(range(1, 33)) AS n FROM v) SELECT vec_id, 1.5 + n * 3.3 AS depth FROM d WHERE 1.5 + n * 3.3 <= 60 AND 1.5 + n * 3.3 >= -60".replace("1.5 + n * 3.3 AS depth", "round(1.5 + n * 3.3, 6) AS depth"))
def win1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.explode(walk.depths(1.5, 3.3, 1, -60, 60)).alias("depth")).select("vec_id", F.round("depth", 6).alias("depth"))


# --- series of images: parts of the driver's line items ---

INST_SQL = "inst AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_key, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_linenumber AS instance_number, l_orderkey, l_partkey, l_extendedprice FROM lineitem)"
TIE = ["l_orderkey", "l_partkey", "l_extendedprice"]
NORMAL = (0.6, 0.0, 0.8)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(c("l_suppkey").cast("string").alias("series_key"), c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), (c("l_tax") * 100).alias("z"), c("l_linenumber").alias("instance_number"), *TIE)


@query("agg1_series_group", "SELECT coalesce(nullif(CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END, ''), l_returnflag || '#' || CAST(l_linenumber AS VARCHAR)) AS series_key, min(l_linenumber) AS series_number, count(*) AS n FROM lineitem GROUP BY 1")
def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by series UID, or by study and number where it is empty."""
    uid = F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.col("l_suppkey").cast("string"))
    i = table(spark, sf_dir, "lineitem").select(series.series_key(uid, F.col("l_returnflag"), F.col("l_linenumber")).alias("series_key"), F.col("l_linenumber").alias("series_number"))
    return i.groupBy("series_key").agg(F.min("series_number").alias("series_number"), F.count("*").alias("n"))


ORDER_SQL = f"{INST_SQL}, o AS (SELECT *, 0.6 * x + 0.0 * y + 0.8 * z AS depth FROM inst), s AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY depth, instance_number, l_orderkey, l_partkey, l_extendedprice) - 1 AS k FROM o)"


@query("srt1_slice_order", f"WITH {ORDER_SQL} SELECT series_key, CAST(k AS INTEGER) AS k, l_orderkey, instance_number, round(depth, 6) AS depth FROM s")
def srt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.ordered(images(spark, sf_dir), NORMAL, TIE).select("series_key", "k", "l_orderkey", "instance_number", F.round("depth", 6).alias("depth"))


@query("agg6_slice_spacing", f"WITH {ORDER_SQL}, gp AS (SELECT series_key, depth - lag(depth) OVER (PARTITION BY series_key ORDER BY k) AS gap FROM s), m AS (SELECT series_key, median(gap) AS spacing FROM gp WHERE gap IS NOT NULL GROUP BY 1) SELECT series_key, round(spacing, 6) AS spacing, count(*) FILTER (WHERE abs(gap - spacing) > 0.01) AS n_uneven FROM gp JOIN m USING (series_key) WHERE gap IS NOT NULL GROUP BY series_key, spacing")
def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series.ordered(images(spark, sf_dir), NORMAL, TIE)
    return series.spacing(s, TIE).select("series_key", F.round("spacing", 6).alias("spacing"), "n_uneven")


@query("agg7_shear_check", f"WITH {ORDER_SQL}, st AS (SELECT series_key, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM s WINDOW w AS (PARTITION BY series_key ORDER BY k)), sd AS (SELECT series_key, dx - 0.6 * (0.6 * dx + 0.8 * dz) AS sx, dy AS sy, dz - 0.8 * (0.6 * dx + 0.8 * dz) AS sz FROM st WHERE dx IS NOT NULL) SELECT series_key, bool_or(sqrt(sx * sx + sy * sy + sz * sz) > 0.5) AS shear FROM sd GROUP BY 1")
def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sheared(series.ordered(images(spark, sf_dir), NORMAL, TIE), NORMAL)


DESC = "concat(p_name, '_', p_type, CASE p_partkey % 5 WHEN 0 THEN '_t1 tse' WHEN 1 THEN '_pd_tse_fs' WHEN 2 THEN '_t2-STIR' WHEN 3 THEN ' PDw' ELSE '' END)"
KIND = f"CASE WHEN regexp_matches(t, '{rules.FAT_SAT}') THEN 'fatsat' WHEN regexp_matches(t, '{rules.T1_WORD}') THEN 't1' WHEN regexp_matches(t, '{rules.T2_WORD}') OR regexp_matches(t, '{rules.PD_WORD}') THEN 't2' ELSE 'unknown' END"
DESC_SQL = f"ds AS (SELECT *, regexp_replace(lower({DESC}), '[\\s-]+', '_', 'g') AS t FROM part), kd AS (SELECT *, {KIND} AS kind FROM ds)"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 5 == 0, "_t1 tse").when(F.col("p_partkey") % 5 == 1, "_pd_tse_fs").when(F.col("p_partkey") % 5 == 2, "_t2-STIR").when(F.col("p_partkey") % 5 == 3, " PDw").otherwise("")
    d = F.concat("p_name", F.lit("_"), "p_type", suffix)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", rules.sequence_kind(d).alias("kind"))


@query("rul6_sequence_kind", f"WITH {DESC_SQL} SELECT p_partkey, kind FROM kd")
def rul6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("p_partkey", "kind")


VOL_SQL = f"{DESC_SQL}, vol AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS uid, kind, p_brand || CAST(p_size AS VARCHAR) AS frame, p_size AS slices, sin(p_retailprice) AS ax, 0.0 AS ay, cos(p_retailprice) AS az FROM kd)"


def study_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return described(spark, sf_dir).select(F.lpad(c("p_partkey").cast("string"), 10, "0").alias("uid"), "kind", F.concat("p_brand", c("p_size").cast("string")).alias("frame"), c("p_size").alias("slices"), F.sin("p_retailprice").alias("ax"), F.lit(0.0).alias("ay"), F.cos("p_retailprice").alias("az"))


@query("join5_sequence_pair", f"WITH {VOL_SQL}, p AS (SELECT a.uid AS active, b.uid AS partner, round(abs(a.ax * b.ax + a.ay * b.ay + a.az * b.az), 9) AS agreement, b.slices FROM vol a JOIN vol b ON a.frame = b.frame AND a.uid <> b.uid AND ((a.kind = 't1' AND b.kind = 'fatsat') OR (a.kind = 'fatsat' AND b.kind = 't1'))) SELECT active, partner, agreement, agreement < 0.99 AS oblique FROM p QUALIFY row_number() OVER (PARTITION BY active ORDER BY agreement DESC, slices DESC, partner) = 1")
def join5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.best_partner(study_volumes(spark, sf_dir))


@query("join6_pair_for", f"WITH {VOL_SQL}, me AS (SELECT min(a.uid) AS uid FROM vol a JOIN vol b ON a.frame = b.frame AND a.kind = 'fatsat' AND b.kind = 't1'), p AS (SELECT b.uid AS t1, a.uid AS fatsat, round(abs(a.ax * b.ax + a.ay * b.ay + a.az * b.az), 9) AS agreement, b.slices FROM me JOIN vol a ON a.uid = me.uid JOIN vol b ON a.frame = b.frame AND b.kind = 't1') SELECT t1, fatsat, agreement, agreement < 0.99 AS oblique FROM p QUALIFY row_number() OVER (ORDER BY agreement DESC, slices DESC, t1) = 1")
def join6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of the first fat-saturated series that has a partner."""
    v = study_volumes(spark, sf_dir)
    of = v.filter("kind = 'fatsat'").join(v.filter("kind = 't1'").select("frame"), "frame", "left_semi").agg(F.min("uid")).first()[0]
    return series.pair_for(v, of or "")


@query("agg17_fusion_candidate", f"WITH {VOL_SQL}, a AS (SELECT x.kind, x.frame FROM vol x JOIN vol y ON x.kind = y.kind AND x.frame = y.frame AND x.uid < y.uid WHERE abs(x.ax * y.ax + x.ay * y.ay + x.az * y.az) < 0.9 GROUP BY 1, 2) SELECT kind, frame, count(*) AS n, min(uid) AS first FROM vol JOIN a USING (kind, frame) WHERE kind <> 'unknown' GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, first LIMIT 1")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fusion_candidate(study_volumes(spark, sf_dir))


@query("flt1_shared_frame", f"WITH {VOL_SQL} SELECT frame, count(*) >= 2 AND min(kind) = max(kind) AND min(kind) <> '' AS shared FROM vol GROUP BY frame")
def flt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all series of a group name one and the same non-empty frame (kinds stand for frames)."""
    return study_volumes(spark, sf_dir).groupBy("frame").agg(((F.count("*") >= 2) & (F.min("kind") == F.max("kind")) & (F.min("kind") != "")).alias("shared"))
