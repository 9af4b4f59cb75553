"""2D masks: pixels as rows (mask_id, y, x), run lengths, morphology, measures.

Set operations and stencils are equi-joins or groupings on (mask_id, y, x); only
run lengths need a window, over one mask's pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NINE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
KEY = ["mask_id", "y", "x"]


def encode_runs(dense: DataFrame) -> DataFrame:
    """mask_id, run, length of dense pixels (mask_id, pos, bit); run 0 counts zeros and may be 0 long."""
    w = Window.partitionBy("mask_id").orderBy("pos")
    change = F.when(F.col("bit") != F.coalesce(F.lag("bit").over(w), F.lit(False)), 1).otherwise(0)
    runs = dense.withColumn("c", change).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("mask_id", "run").agg(F.count("*").alias("length"))
    # a mask that starts with a set pixel has an empty first run
    empty = dense.filter("pos = 0 and bit").select("mask_id", F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("length"))
    return runs.select("mask_id", F.col("run").cast("long").alias("run"), "length").unionByName(empty)


def decode_runs(runs: DataFrame) -> DataFrame:
    """mask_id, pos of the set pixels."""
    w = Window.partitionBy("mask_id").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    ends = runs.withColumn("stop", F.sum("length").over(w)).filter("run % 2 = 1 and length > 0")
    return ends.select("mask_id", F.explode(F.sequence(F.col("stop") - F.col("length"), F.col("stop") - 1)).alias("pos"))


def _spread(pixels: DataFrame, offsets: list[tuple[int, int]], size: DataFrame) -> DataFrame:
    moved = pixels.select("mask_id", "y", "x", F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets))).alias("o"))
    moved = moved.select("mask_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return moved.join(size, "mask_id").filter("y >= 0 and x >= 0 and y < height and x < width").select(*KEY)


def dilate(pixels: DataFrame, size: DataFrame) -> DataFrame:
    """Pixels with a set one among their nine; ``size``: mask_id, width, height."""
    return _spread(pixels, NINE, size).distinct()


def erode(pixels: DataFrame, size: DataFrame) -> DataFrame:
    """Pixels all of whose nine are set; beyond the edge nothing is."""
    return _spread(pixels, NINE, size).groupBy(*KEY).agg(F.count("*").alias("n")).filter("n = 9").select(*KEY)


def tidy(pixels: DataFrame, size: DataFrame) -> DataFrame:
    return dilate(erode(pixels, size), size)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, KEY, "left_anti")


def outline(pixels: DataFrame, size: DataFrame) -> DataFrame:
    """Set pixels with a clear neighbour among their four, or on the border."""
    near = _spread(pixels, [(0, 1), (0, -1), (1, 0), (-1, 0)], size).groupBy(*KEY).agg(F.count("*").alias("n"))
    return pixels.join(near, KEY, "left").filter("coalesce(n, 0) < 4").select(*KEY)


def measures(pixels: DataFrame) -> DataFrame:
    """mask_id, area, half-open bounds and centroid."""
    return pixels.groupBy("mask_id").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def prompt_box(pixels: DataFrame, size: DataFrame, share: float = 0.12) -> DataFrame:
    """Bounds padded by a share of their size, clamped to the picture."""
    m = measures(pixels).join(size, "mask_id")
    px, py = (F.col("x1") - F.col("x0")) * share, (F.col("y1") - F.col("y0")) * share
    low = lambda v: F.greatest(F.lit(0.0), v)
    return m.select("mask_id", low(F.col("x0") - px).alias("left"), low(F.col("y0") - py).alias("top"), F.least(F.col("width").cast("double"), F.col("x1") + px).alias("right"), F.least(F.col("height").cast("double"), F.col("y1") + py).alias("bottom"))


def interior_point(pixels: DataFrame, size: DataFrame) -> DataFrame:
    """mask_id, y, x deep inside: eroded up to twice while something is left, its rounded centroid if set, else the set pixel nearest to it (row-major first)."""
    once = erode(pixels, size)
    twice = erode(once, size)
    depth = pixels.select(*KEY, F.lit(0).alias("d")).unionByName(once.withColumn("d", F.lit(1))).unionByName(twice.withColumn("d", F.lit(2)))
    deepest = depth.groupBy("mask_id").agg(F.max("d").alias("d"))
    core = depth.join(deepest, ["mask_id", "d"]).select(*KEY)
    mid = measures(core).select("mask_id", F.floor(F.col("cx") + 0.5).alias("mx"), F.floor(F.col("cy") + 0.5).alias("my"))
    far = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
    best = core.join(mid, "mask_id").groupBy("mask_id").agg(F.min(F.struct(far.alias("far"), "y", "x")).alias("b"))
    return best.select("mask_id", F.col("b.y").alias("y"), F.col("b.x").alias("x"))


def heat_threshold(values: DataFrame, share: float = 0.6) -> DataFrame:
    """Set pixels of heat maps (mask_id, y, x, value): at least ``share`` of the peak; none where the peak is not positive."""
    peak = values.groupBy("mask_id").agg(F.max("value").alias("peak"))
    return values.join(peak, "mask_id").filter((F.col("peak") > 0) & (F.col("value") >= F.col("peak") * share)).select(*KEY)


def resample(pixels: DataFrame, target: DataFrame, sx: float, sy: float) -> DataFrame:
    """Target pixels (mask_id, y, x) that read a set source pixel, ``sx``/``sy`` source pixels a target pixel."""
    at = lambda c, s: F.floor((F.col(c) + 0.5) * s - 0.5 + 0.5).cast("int")
    asked = target.select(*KEY, at("x", sx).alias("px"), at("y", sy).alias("py"))
    return asked.join(pixels.select("mask_id", F.col("x").alias("px"), F.col("y").alias("py")), ["mask_id", "px", "py"], "left_semi").select(*KEY)


def volume_mm3(pixels: DataFrame, spacing: float, thickness: float) -> DataFrame:
    return pixels.groupBy("mask_id").agg((F.count("*") * spacing * spacing * thickness).alias("mm3"))
