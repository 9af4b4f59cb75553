"""Queries over lines through voxel grids: a slab of an oblique plane, a ray march."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions import geometry as g
from voxelake.operators import lines, slabs
from voxelake.plans.registry import query
from voxelake.sources.grids import T1_SQL, t1_voxels

# Affine of the grid: turned about the z axis by a quarter of a right angle, moved, slices 1.25 mm apart.
M = (0.9, -0.3, 0.0, 2.0, 0.3, 0.9, 0.0, -1.0, 0.0, 0.0, 1.25, 4.0)
#: Eight corners of a read at x, y, z (clamped), as SQL over the table ``{of}`` with key {key}.
READ = """c_{of} AS (SELECT {key}, least(greatest(x, 0.0), 7.0) AS x, least(greatest(y, 0.0), 7.0) AS y, least(greatest(z, 0.0), nz - 1.0) AS z, nz FROM {of}),
r_{of} AS (SELECT {key}, (least(floor(z) + c, nz - 1) * 64 + least(floor(y) + b, 7) * 8 + least(floor(x) + a, 7)) AS at, abs(1 - a - (x - floor(x))) * abs(1 - b - (y - floor(y))) * abs(1 - c - (z - floor(z))) AS w FROM c_{of}, range(2) ra(a), range(2) rb(b), range(2) rc(c)),
v_{of} AS (SELECT {key}, sum(w * stored) AS value FROM r_{of} JOIN t1 ON t1.idx = r_{of}.at GROUP BY {key})"""

# no sample lies on the face of the box, where rounding would decide
U, V, ORIGIN = (0.8, 0.0, 0.6), (0.0, 1.0, 0.0), (3.0713, 2.5377)


def _inverse() -> tuple[float, ...]:
    a, b, _, tx, d, e, _, ty, _, _, i, tz = M
    det = a * e - b * d
    x, y = (e / det, -b / det), (-d / det, a / det)
    return (*x, 0.0, -(x[0] * tx + x[1] * ty), *y, 0.0, -(y[0] * tx + y[1] * ty), 0.0, 0.0, 1 / i, -tz / i)


W = _inverse()
OBLIQUE_SQL = f"""WITH {T1_SQL}, n AS (SELECT max(k) + 1 AS nz FROM t1),
px AS (SELECT k * 64 + p AS pixel, k, p, {ORIGIN[0]} + {U[0]} * (p % 8 - 3.5) AS x0, {ORIGIN[1]} + (p // 8 - 3.5) AS y0, 4.0171 + 1.25 * k + {U[2]} * (p % 8 - 3.5) AS z0, nz FROM (SELECT DISTINCT k FROM t1), range(64) r(p), n),
pt AS (SELECT pixel, st, x0 - 0.6 * o AS px, y0 AS py, z0 + 0.8 * o AS pz, nz FROM (SELECT *, (st / 6.0 - 0.5) * 9.0 AS o FROM px, range(7) s(st))),
sm AS (SELECT pixel, st, {W[0]!r} * px + {W[1]!r} * py + {W[3]!r} AS x, {W[4]!r} * px + {W[5]!r} * py + {W[7]!r} AS y, {W[10]!r} * pz + {W[11]!r} AS z, px, py, pz, nz FROM pt),
ins AS (SELECT * FROM sm WHERE x >= -0.5 AND y >= -0.5 AND z >= -0.5 AND x <= 7.5 AND y <= 7.5 AND z <= nz - 0.5),
{READ.format(of="ins", key="pixel, st")},
b AS (SELECT pixel, round(value, 5) AS top, st FROM v_ins QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY value DESC, st) = 1)
SELECT pixel, top, round(px, 5) AS px, round(py, 5) AS py, round(pz, 5) AS pz FROM b JOIN sm USING (pixel, st)"""


@query("geo17_oblique_slab", OBLIQUE_SQL)
def geo17_oblique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane leaning along the stack, one for every slice: greatest value of seven samples across 9 mm, and where in the patient."""
    v = t1_voxels(spark, sf_dir).withColumnRenamed("stored", "value")
    grid = slabs.grid_of(v)
    pixels = grid.select("volume_id", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("k")).repartition("volume_id", "k").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    pixels = pixels.select("volume_id", (F.col("k") * 64 + F.col("p")).cast("long").alias("pixel"), "k", (F.col("p") % 8 - 3.5).cast("double").alias("a"), (F.floor(F.col("p") / 8) - 3.5).cast("double").alias("b"))
    origin = (F.lit(ORIGIN[0]), F.lit(ORIGIN[1]), F.lit(4.0171) + F.col("k") * 1.25)
    own = lines.plane_lines(pixels, origin, U, V, 9.0, 7, W)
    best = lines.projected(own, v, grid, "pixel")
    at = g.apply_affine(M, tuple(F.col(c) for c in "xyz"))
    return best.select("pixel", F.round("value", 5).alias("top"), *(F.round(x, 5).alias("p" + c) for c, x in zip("xyz", at, strict=True)))


# Window, opacity and threshold of the march; grids are noise around 2000.
CENTER, WIDTH, OPACITY, THRESHOLD, EDGE, LIGHT, STEP = 2000.0, 1000.0, 1.6, 0.35, 0.5, 0.7, 0.5
GRAD = " UNION ALL ".join(f"SELECT id, st, '{n}{'p' if s > 0 else 'm'}' AS g, x + {s if n == 'x' else 0} AS x, y + {s if n == 'y' else 0} AS y, z + {s if n == 'z' else 0} AS z, nz FROM sm" for n in "xyz" for s in (1, -1))
MARCH_SQL = f"""WITH {T1_SQL}, n AS (SELECT max(k) + 1 AS nz FROM t1),
e AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, nz FROM embeddings, n),
d AS (SELECT id, nz, x / m AS dx, y / m AS dy, z / m AS dz, 3.5 - 12 * (x / m) AS ox, 3.5 - 12 * (y / m) AS oy, id - 12 * (z / m) AS oz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS m FROM e)),
bx AS (SELECT *, greatest(least((-0.5 - ox) / dx, (7.5 - ox) / dx), least((-0.5 - oy) / dy, (7.5 - oy) / dy), least((-0.5 - oz) / dz, (nz - 0.5 - oz) / dz)) AS near, least(greatest((-0.5 - ox) / dx, (7.5 - ox) / dx), greatest((-0.5 - oy) / dy, (7.5 - oy) / dy), greatest((-0.5 - oz) / dz, (nz - 0.5 - oz) / dz)) AS far FROM d),
sm AS (SELECT id, st, t, ox + dx * t AS x, oy + dy * t AS y, oz + dz * t AS z, nz FROM (SELECT *, greatest(near, 0) + st * {STEP} AS t FROM bx, range(1024) r(st) WHERE far > greatest(near, 0)) WHERE t <= far),
{READ.format(of="sm", key="id, st")},
gm AS ({GRAD}), {READ.format(of="gm", key="id, st, g")},
w AS (SELECT id, st, greatest(0.0, least(1.0, (value - {CENTER - WIDTH / 2}) / {WIDTH})) AS gray FROM v_sm),
gw AS (SELECT id, st, {', '.join(f"sum(CASE g WHEN '{n}p' THEN q WHEN '{n}m' THEN -q ELSE 0 END) AS g{n}" for n in 'xyz')} FROM (SELECT id, st, g, greatest(0.0, least(1.0, (value - {CENTER - WIDTH / 2}) / {WIDTH})) AS q FROM v_gm) GROUP BY id, st),
s AS (SELECT id, st, t, gray, sqrt(gx * gx + gy * gy + gz * gz) AS size, abs(gx * dx + gy * dy + gz * dz) AS across, dz FROM w JOIN gw USING (id, st) JOIN sm USING (id, st) JOIN d USING (id) WHERE gray > {THRESHOLD}),
a AS (SELECT id, st, t, greatest(0.0, least(1.0, power((gray - {THRESHOLD}) / {1 - THRESHOLD!r}, 2) * (1 + (least(size * 12, 1.0) - 1) * {EDGE}) * {OPACITY} * {STEP})) AS alpha, gray * (1 + (0.35 + 0.65 * CASE WHEN size > 1e-5 THEN across / size ELSE abs(dz) END - 1) * {LIGHT}) AS gray FROM s),
c AS (SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER (PARTITION BY id ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS clear FROM a WHERE alpha > 0.0005),
f AS (SELECT id, 1 - min(clear * (1 - alpha)) AS alpha, sum(clear * alpha * gray) AS gray, min(t) FILTER (WHERE 1 - clear * (1 - alpha) > 0.995) AS stop FROM c WHERE 1 - clear <= 0.995 GROUP BY id)
SELECT d.id AS vec_id, round(coalesce(alpha, 0), 6) AS alpha, round(coalesce(gray, 0), 6) AS gray, round(stop, 6) AS stop FROM d LEFT JOIN f USING (id)"""


@query("geo16_march", MARCH_SQL)
def geo16_march(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays through the middle of every slice, from 12 voxels away, at each embedding's own angle."""
    v = t1_voxels(spark, sf_dir).withColumnRenamed("stored", "value")
    grid = slabs.grid_of(v)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *(F.get("embedding", F.lit(n)).cast("double").alias(c) for n, c in enumerate("xyz")))
    e = e.withColumn("size", g.length(tuple(F.col(c) for c in "xyz")))
    target = dict(zip("xyz", (F.lit(3.5), F.lit(3.5), F.col("vec_id").cast("double")), strict=True))
    cameras = e.select(F.lit("t1").alias("volume_id"), "vec_id", *((t - 12 * F.try_divide(c, "size")).alias("o" + c) for c, t in target.items()), *(t.alias("t" + c) for c, t in target.items()))
    seen = lines.march(lines.rays(cameras, grid, STEP), v, grid, "vec_id", center=CENTER, width=WIDTH, opacity=OPACITY, threshold=THRESHOLD, edge_boost=EDGE, light=LIGHT)
    return seen.select("vec_id", *(F.round(c, 6).alias(c) for c in ("alpha", "gray", "stop")))
