"""Queries over 2D masks, walks and sessions; masks and walks are read from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelake.operators import masks, session, walk
from voxelake.plans.registry import query, table
from voxelake.sources.shared import stored
from voxelake.streaming import streams, walks

W = 8
DENSE_SQL = "px AS (SELECT user_id AS mask_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value > 8 AS bit, value FROM events), dense AS (SELECT mask_id, pos, pos // 8 AS y, pos % 8 AS x, bit, value FROM px), m AS (SELECT mask_id, y, x FROM dense WHERE bit), size AS (SELECT mask_id, 8 AS width, max(y) + 1 AS height FROM dense GROUP BY mask_id)"


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("mask_id"), n.cast("long").alias("pos"), (F.col("value") > 8).alias("bit"), "value")
    return d.withColumn("y", F.floor(F.col("pos") / W)).withColumn("x", F.col("pos") % W)


def pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = dense(spark, sf_dir)
    return d.filter("bit").select("mask_id", "y", "x"), d.groupBy("mask_id").agg(F.lit(W).alias("width"), (F.max("y") + 1).alias("height"))


@query("grf7_rle", f"WITH {DENSE_SQL}, c AS (SELECT *, CASE WHEN bit <> coalesce(lag(bit) OVER w, false) THEN 1 ELSE 0 END AS ch FROM dense WINDOW w AS (PARTITION BY mask_id ORDER BY pos)), r AS (SELECT mask_id, sum(ch) OVER (PARTITION BY mask_id ORDER BY pos) AS run FROM c) SELECT mask_id, CAST(run AS BIGINT) AS run, count(*) AS length FROM r GROUP BY 1, 2 UNION ALL SELECT mask_id, 0, 0 FROM dense WHERE pos = 0 AND bit")
def grf7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.encode_runs(dense(spark, sf_dir))


@query("grf7_rle_roundtrip", f"WITH {DENSE_SQL} SELECT mask_id, pos FROM dense WHERE bit")
def grf7_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.decode_runs(masks.encode_runs(dense(spark, sf_dir)))


AROUND = "FROM m, range(-1, 2) ra(dy), range(-1, 2) rb(dx), size WHERE size.mask_id = m.mask_id AND m.y + dy >= 0 AND m.x + dx >= 0 AND m.x + dx < 8 AND m.y + dy < height"


@query("grf5_dilate", f"WITH {DENSE_SQL} SELECT DISTINCT m.mask_id, m.y + dy AS y, m.x + dx AS x {AROUND}")
def grf5_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.dilate(*pixels(spark, sf_dir))


@query("grf5_erode", f"WITH {DENSE_SQL} SELECT m.mask_id, m.y + dy AS y, m.x + dx AS x {AROUND} GROUP BY 1, 2, 3 HAVING count(*) = 9")
def grf5_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.erode(*pixels(spark, sf_dir))


@query("grf5_tidy", f"WITH {DENSE_SQL}, e AS (SELECT m.mask_id, m.y + dy AS y, m.x + dx AS x {AROUND} GROUP BY 1, 2, 3 HAVING count(*) = 9) SELECT DISTINCT e.mask_id, e.y + dy AS y, e.x + dx AS x FROM e, range(-1, 2) ra(dy), range(-1, 2) rb(dx), size WHERE size.mask_id = e.mask_id AND e.y + dy BETWEEN 0 AND height - 1 AND e.x + dx BETWEEN 0 AND 7")
def grf5_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.tidy(*pixels(spark, sf_dir))


OTHER = "o AS (SELECT mask_id, y, x FROM dense WHERE value > 80 OR value < 10)"


def other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).filter("value > 80 or value < 10").select("mask_id", "y", "x")


@query("grf6_union", f"WITH {DENSE_SQL}, {OTHER} SELECT * FROM m UNION SELECT * FROM o")
def grf6_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.union(pixels(spark, sf_dir)[0], other(spark, sf_dir))


@query("grf6_subtract", f"WITH {DENSE_SQL}, {OTHER} SELECT * FROM m EXCEPT SELECT * FROM o")
def grf6_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.subtract(pixels(spark, sf_dir)[0], other(spark, sf_dir))


@query("grf8_threshold", f"WITH {DENSE_SQL} SELECT mask_id, y, x FROM dense JOIN (SELECT mask_id, max(value) AS peak FROM dense GROUP BY 1) USING (mask_id) WHERE peak > 0 AND value >= peak * 0.6")
def grf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.heat_threshold(dense(spark, sf_dir))


@query("grf9_interior_point", f"""WITH {DENSE_SQL}, e1 AS (SELECT m.mask_id, m.y + dy AS y, m.x + dx AS x {AROUND} GROUP BY 1, 2, 3 HAVING count(*) = 9),
e2 AS (SELECT e.mask_id, e.y + dy AS y, e.x + dx AS x FROM e1 e, range(-1, 2) ra(dy), range(-1, 2) rb(dx) GROUP BY 1, 2, 3 HAVING count(*) = 9),
dp AS (SELECT *, 0 AS d FROM m UNION ALL SELECT *, 1 FROM e1 UNION ALL SELECT *, 2 FROM e2), core AS (SELECT mask_id, y, x FROM dp QUALIFY d = max(d) OVER (PARTITION BY mask_id)),
mid AS (SELECT mask_id, floor(avg(x) + 0.5) AS mx, floor(avg(y) + 0.5) AS my FROM core GROUP BY 1)
SELECT mask_id, y, x FROM core JOIN mid USING (mask_id) QUALIFY row_number() OVER (PARTITION BY mask_id ORDER BY (x - mx) * (x - mx) + (y - my) * (y - my), y, x) = 1""")
def grf9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.interior_point(*pixels(spark, sf_dir))


@query("grf10_prompt_box", f"WITH {DENSE_SQL}, b AS (SELECT mask_id, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM m GROUP BY 1) SELECT mask_id, round(greatest(0, x0 - (x1 - x0) * 0.12), 6) AS left_, round(greatest(0, y0 - (y1 - y0) * 0.12), 6) AS top, round(least(8, x1 + (x1 - x0) * 0.12), 6) AS right_, round(least(height, y1 + (y1 - y0) * 0.12), 6) AS bottom FROM b JOIN size USING (mask_id)")
def grf10(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = masks.prompt_box(*pixels(spark, sf_dir))
    return b.select("mask_id", F.round("left", 6).alias("left_"), F.round("top", 6).alias("top"), F.round("right", 6).alias("right_"), F.round("bottom", 6).alias("bottom"))


@query("grf12_outline", f"WITH {DENSE_SQL} SELECT m.mask_id, m.y, m.x FROM m WHERE (SELECT count(*) FROM m n WHERE n.mask_id = m.mask_id AND abs(n.y - m.y) + abs(n.x - m.x) = 1) < 4")
def grf12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.outline(*pixels(spark, sf_dir))


@query("agg9_mask_stats", f"WITH {DENSE_SQL} SELECT mask_id, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM m GROUP BY 1")
def agg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.measures(pixels(spark, sf_dir)[0]).withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query("agg10_mask_volume", f"WITH {DENSE_SQL} SELECT mask_id, round(count(*) * 0.25 * 3.3, 6) AS mm3 FROM m GROUP BY 1")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.volume_mm3(pixels(spark, sf_dir)[0], 0.5, 3.3).withColumn("mm3", F.round("mm3", 6))


@query("agg11_object_volume", f"WITH {DENSE_SQL} SELECT mask_id % 10 AS object_id, count(DISTINCT (y * 8 + x)) AS voxels, round(count(DISTINCT (y * 8 + x)) * 0.825, 6) AS mm3 FROM m GROUP BY 1")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct voxels of all cuts of an object (ten objects over the masks)."""
    m = pixels(spark, sf_dir)[0].select((F.col("mask_id") % 10).alias("object_id"), (F.col("y") * W + F.col("x")).alias("v")).distinct()
    return m.groupBy("object_id").agg(F.count("*").alias("voxels"), F.round(F.count("*") * 0.825, 6).alias("mm3"))


@query("join7_mask_voxels", f"WITH {DENSE_SQL}, p AS (SELECT mask_id, floor(x * 0.7 + 1 + 0.5) AS i, floor(y * 0.7 - 1 + 0.5) AS j FROM m) SELECT DISTINCT mask_id, CAST(j * 8 + i AS BIGINT) AS idx FROM p WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7")
def join7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask pixels as voxels of an 8 x 8 grid of another pitch and origin."""
    i, j = F.floor(F.col("x") * 0.7 + 1 + 0.5), F.floor(F.col("y") * 0.7 - 1 + 0.5)
    return pixels(spark, sf_dir)[0].select("mask_id", i.alias("i"), j.alias("j")).filter("i between 0 and 7 and j between 0 and 7").select("mask_id", (F.col("j") * 8 + F.col("i")).alias("idx")).distinct()


@query("join8_resample_mask", f"WITH {DENSE_SQL}, t AS (SELECT size.mask_id, y, x FROM size, range(0, 20) ry(y), range(0, 16) rx(x)) SELECT t.mask_id, t.y, t.x FROM t JOIN m ON m.mask_id = t.mask_id AND m.x = floor((t.x + 0.5) * 0.5 - 0.5 + 0.5) AND m.y = floor((t.y + 0.5) * 0.5 - 0.5 + 0.5)")
def join8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask on a 16 x 20 frame of half the pitch."""
    m, size = pixels(spark, sf_dir)
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    target = size.select("mask_id", F.explode(cells).alias("c")).select("mask_id", F.col("c.y").cast("long").alias("y"), F.col("c.x").cast("long").alias("x"))
    return masks.resample(m.withColumn("x", F.col("x").cast("int")).withColumn("y", F.col("y").cast("int")), target, 0.5, 0.5)


# --- walks ---

WALK_SQL = """s AS (SELECT user_id AS walk_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step, CAST(floor(value) AS BIGINT) AS area, value / 100 AS score FROM events),
j AS (SELECT *, lag(area) OVER w AS p, first_value(area) OVER w AS seed FROM s WINDOW w AS (PARTITION BY walk_id ORDER BY step)),
c AS (SELECT *, CASE WHEN step = 0 THEN NULL WHEN area = 0 THEN 'vanished' WHEN area < 24 THEN 'collapsed' WHEN p > 0 AND area > p * 2.5 THEN 'leaked' WHEN p > 0 AND area < p * 0.4 THEN 'collapsed' WHEN seed > 0 AND area > seed * 3.0 THEN 'drifted' WHEN score < 0.5 THEN 'low-score' END AS cause FROM j)"""


def walk_slices(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("walk_id"), step.alias("step"), F.floor("value").alias("area"), (F.col("value") / 100).alias("score"), *more)


@query("win2_judge", f"WITH {WALK_SQL} SELECT walk_id, step, area, cause FROM c")
def win2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.judged(walk_slices(spark, sf_dir)).select("walk_id", "step", "area", "cause")


WIN3_SQL = f"WITH {WALK_SQL}, e AS (SELECT walk_id, min(step) FILTER (WHERE cause IS NOT NULL AND step <= 32) AS stop_at, max(step) AS last FROM c WHERE step > 0 GROUP BY 1) SELECT e.walk_id, coalesce(stop_at - 1, least(last, 32)) AS kept, coalesce(c.cause, CASE WHEN last < 32 THEN 'edge' ELSE 'limit' END) AS stop FROM e LEFT JOIN c ON c.walk_id = e.walk_id AND c.step = stop_at"


@query("win3_walk", WIN3_SQL)
def win3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walks(walk_slices(spark, sf_dir))


#: Most micro-batches in which the slices of all walks arrive; four files are one at least.
ARRIVALS = 4


@query("win3_stream", WIN3_SQL)
def win3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same walks from a stream of slices in a shuffled order: each stops as its first cause arrives."""
    slices = walk_slices(spark, sf_dir, "ts").withColumn("ts", F.col("ts").cast("timestamp")).orderBy(F.xxhash64("walk_id", "step"))
    path = stored(slices, "slices")
    # as many arrivals for long logs as for short ones: a walk is taken up once for each
    files = -(-len(spark.read.schema(slices.schema).parquet(path).inputFiles()) // ARRIVALS)
    arriving = spark.readStream.schema(slices.schema).option("maxFilesPerTrigger", max(4, files)).parquet(path)
    seen = streams.run_to_table(walks.walk_stream(arriving, late="10000 days"), "update", ["walk_id"], "version")
    return seen.select("walk_id", "kept", "stop")


@query("win6_newest_answer", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def win6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest answer of each kind wins; older ones that come late change nothing."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


WIN4_SQL = "WITH RECURSIVE f AS (SELECT vec_id, 0 AS i, CAST([] AS DOUBLE[]) AS cuts, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 100) AS e FROM embeddings UNION ALL SELECT vec_id, i + 1, CASE WHEN len(list_filter(cuts, lambda c: abs(c - e[i + 1]) <= 1.65 + 1e-9)) > 0 THEN cuts ELSE list_append(cuts, e[i + 1]) END, e FROM f WHERE i < len(e)) SELECT vec_id, len(cuts) AS n_cuts, round(cuts[1], 6) AS first FROM f WHERE i = len(e)"


@query("win4_group_by_cut", WIN4_SQL)
def win4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cuts: the first depth that fits no cut so far opens one; order decides."""
    step = lambda acc, d: F.when(F.exists(acc, lambda c: F.abs(c - d) <= 1.65 + 1e-9), acc).otherwise(F.concat(acc, F.array(d)))
    one = F.aggregate(F.transform("e", lambda x: x * 100), F.array().cast("array<double>"), step)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", F.size(one).alias("n_cuts"), F.round(F.get(one, F.lit(0)), 6).alias("first"))


@query("join10_band_cut", "WITH p AS (SELECT user_id, event_id, value AS depth FROM events WHERE event_type = 'click'), c AS (SELECT user_id, event_id AS cut_id, value AS cut_at FROM events WHERE event_type = 'view') SELECT p.event_id, min(cut_id) AS cut_id FROM p JOIN c ON c.user_id = p.user_id AND abs(depth - cut_at) <= 1.65 GROUP BY 1")
def join10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts to the first cut within half a slab: bands as equi-keys, the neighbours exploded, then the exact test."""
    e = table(spark, sf_dir, "events")
    band = lambda c: F.floor(F.col(c) / 3.3)
    p = e.filter("event_type = 'click'").select("user_id", "event_id", F.col("value").alias("depth")).withColumn("band", F.explode(F.sequence(band("depth") - 1, band("depth") + 1)))
    c = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("cut_id"), F.col("value").alias("at")).withColumn("band", band("at"))
    return p.join(c, ["user_id", "band"]).filter(F.abs(F.col("depth") - F.col("at")) <= 1.65).groupBy("event_id").agg(F.min("cut_id").alias("cut_id"))


@query("join11_visible_parts", "SELECT c.event_id FROM events c WHERE c.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events v WHERE v.user_id = c.user_id AND v.event_type = 'view' AND abs(v.value - c.value) <= 1.65)")
def join11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    band = lambda c: F.floor(F.col(c) / 3.3)
    c = e.filter("event_type = 'purchase'").select("user_id", "event_id", "value").withColumn("band", F.explode(F.sequence(band("value") - 1, band("value") + 1)))
    v = e.filter("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("value").alias("at")).withColumn("b", band("at"))
    near = (c["user_id"] == v["u"]) & (c["band"] == v["b"]) & (F.abs(c["value"] - v["at"]) <= 1.65)
    return c.join(v, near, "left_semi").select("event_id").distinct()


# --- sessions ---


OBJECTS = "STRUCT(id BIGINT, cuts STRUCT(c BIGINT, n BIGINT, b BOOLEAN)[])[]"
#: The events of each session in order, and the session after each of them: an undo stack of whole states.
SES_SQL = f"""WITH RECURSIVE ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type AS t, (event_id % 3) * 4 + CAST(floor(abs(value)) AS BIGINT) % 4 AS cut, CAST(floor(abs(value)) AS BIGINT) % 8 + 1 AS pick FROM events),
st AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS {OBJECTS}) AS objs, CAST(NULL AS BIGINT) AS active, CAST(0 AS BIGINT) AS counter, CAST([] AS STRUCT(o {OBJECTS}, a BIGINT)[]) AS past FROM events
UNION ALL SELECT user_id, i + 1, CASE WHEN t = 'signup' THEN list_append(objs, {{'id': counter + 1, 'cuts': CAST([] AS STRUCT(c BIGINT, n BIGINT, b BOOLEAN)[])}}) WHEN t = 'error' AND len(past) > 0 THEN past[len(past)].o
  WHEN t IN ('click', 'purchase') THEN list_transform(base, lambda o: CASE WHEN o.id <> act THEN o WHEN len(list_filter(o.cuts, lambda c: c.c = cut)) > 0
    THEN {{'id': o.id, 'cuts': list_transform(o.cuts, lambda c: CASE WHEN c.c <> cut THEN c ELSE {{'c': c.c, 'n': c.n + hit, 'b': c.b OR hit = 0}} END)}} ELSE {{'id': o.id, 'cuts': list_append(o.cuts, {{'c': cut, 'n': hit, 'b': hit = 0}})}} END) ELSE objs END,
  CASE WHEN t = 'signup' THEN counter + 1 WHEN t = 'error' AND len(past) > 0 THEN past[len(past)].a WHEN t IN ('click', 'purchase') THEN act WHEN picks THEN pick ELSE active END,
  counter + CASE WHEN t = 'signup' OR t IN ('click', 'purchase') AND active IS NULL THEN 1 ELSE 0 END,
  CASE WHEN t IN ('signup', 'click', 'purchase') OR picks THEN list_append(past, {{'o': objs, 'a': active}})[-32:] WHEN t = 'error' AND len(past) > 0 THEN past[:len(past) - 1] ELSE past END
  FROM (SELECT st.*, t, cut, pick, CAST(t = 'click' AS BIGINT) AS hit, coalesce(active, counter + 1) AS act, t = 'view' AND len(list_filter(objs, lambda o: o.id = pick)) > 0 AS picks,
    CASE WHEN active IS NULL THEN list_append(objs, {{'id': counter + 1, 'cuts': CAST([] AS STRUCT(c BIGINT, n BIGINT, b BOOLEAN)[])}}) ELSE objs END AS base FROM st JOIN ev ON ev.user_id = st.user_id AND ev.i = st.i + 1)),
last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
SELECT user_id AS session_id, i AS n_events, len(objs) AS n_objects, CAST(coalesce(list_sum(list_transform(objs, lambda o: len(o.cuts))), 0) AS BIGINT) AS n_cuts,
  CAST(coalesce(list_sum(list_transform(objs, lambda o: coalesce(list_sum(list_transform(o.cuts, lambda c: c.n + CAST(c.b AS BIGINT))), 0))), 0) AS BIGINT) AS n_prompts, CAST(0 AS BIGINT) AS n_grown, active, counter, len(past) AS undo_depth FROM last"""


@query("ses_fold", SES_SQL)
def ses_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.fold(session.from_events(table(spark, sf_dir, "events"))).drop("state")


@query("ses_stream", SES_SQL)
def ses_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold over the events as a stream; the last summary of each session."""
    return streams.latest_sessions(spark, f"{sf_dir}/events.parquet").drop("state")


MARKS_SQL = SES_SQL[: SES_SQL.rindex("SELECT user_id AS session_id")]


@query("ses_marks", MARKS_SQL + "SELECT session_id, object, CAST(sum(n) AS BIGINT) AS clicks, CAST(sum(b) AS BIGINT) AS boxes, round(sum((n + b) * opacity), 6) AS strength, active FROM (SELECT user_id AS session_id, o.id AS object, coalesce(o.id = active, false) AS active, c.n AS n, CAST(c.b AS BIGINT) AS b, CASE WHEN c.c % 4 = 1 THEN 1.0 ELSE 1 - (abs(c.c % 4 - 1) - 0.5) / 19.5 END AS opacity FROM (SELECT user_id, active, o, unnest(o.cuts) AS c FROM (SELECT user_id, active, unnest(objs) AS o FROM last)) WHERE c.c // 4 = 0) GROUP BY ALL")
def ses_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and boxes to draw on the axial cut at depth 1 in the end of each session."""
    cuts = session.cuts(session.fold(session.from_events(table(spark, sf_dir, "events"))))
    at = (F.lit("axial"), F.lit(1.0), 1.0)
    clicks = session.prompt_marks(cuts, *at).select("session_id", "object", "active", "opacity", F.lit(1).alias("click"))
    boxes = session.box_marks(cuts, *at).select("session_id", "object", "active", "opacity", F.lit(0).alias("click"))
    marks = clicks.unionByName(boxes).groupBy("session_id", "object", "active")
    return marks.agg(F.sum("click").alias("clicks"), F.sum(1 - F.col("click")).alias("boxes"), F.round(F.sum("opacity"), 6).alias("strength"))


@query("agg12_prompt_count", "SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS prompts, count(*) FILTER (WHERE event_type = 'view') AS cuts, bool_and(value > 0) AS positive FROM events GROUP BY 1")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.groupBy("user_id").agg(F.count_if(kind.isin("click", "purchase")).alias("prompts"), F.count_if(kind == "view").alias("cuts"), F.bool_and(F.col("value") > 0).alias("positive"))


@query("agg22_best_answer", "SELECT user_id, arg_max(event_id, (value, event_id)) AS event_id, max(value) AS score FROM events GROUP BY 1")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer with the best score, the newer one on ties."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("value", "event_id")).alias("b")).select("user_id", F.col("b.event_id").alias("event_id"), F.col("b.value").alias("score"))
