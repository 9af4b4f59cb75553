"""Grouping images into series, ordering slices, and the checks of a stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelake.functions import geometry as g

AXES = ("ax", "ay", "az")
UNEVEN, SHEAR, TURN = 0.01, 0.5, 0.999  # fixed limits: mm, mm, cosine


def series_key(series_uid: Column, study_uid: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(series_uid, F.lit("")), F.concat(study_uid, F.lit("#"), number.cast("string")))


def series(instances: DataFrame) -> DataFrame:
    """series_key, number, description, n, rows, columns of each group of ``instances``."""
    return instances.groupBy("series_key").agg(F.min("series_number").alias("series_number"), F.min("description").alias("description"), F.count("*").alias("n"), F.count_distinct("rows", "cols").alias("sizes"))


def ordered(instances: DataFrame, normal: g.Vec, tie: list[str]) -> DataFrame:
    """Adds depth along ``normal`` and slice number k; equal depths follow the instance number, then ``tie``."""
    depth = g.dot((F.col("x"), F.col("y"), F.col("z")), normal)
    w = Window.partitionBy("series_key").orderBy("depth", "instance_number", *tie)
    return instances.withColumn("depth", depth).withColumn("k", F.row_number().over(w) - 1)


def spacing(stack: DataFrame, tie: list[str]) -> DataFrame:
    """series_key, spacing (median gap), n_uneven, warning of ordered slices."""
    w = Window.partitionBy("series_key").orderBy("k", *tie)
    gaps = stack.withColumn("gap", F.col("depth") - F.lag("depth").over(w)).filter("gap is not null")
    mid = gaps.groupBy("series_key").agg(F.median("gap").alias("spacing"))
    off = gaps.join(mid, "series_key").groupBy("series_key", "spacing").agg(F.count_if(F.abs(F.col("gap") - F.col("spacing")) > UNEVEN).alias("n_uneven"))
    warning = F.when(F.col("spacing") <= 0, "positions do not advance").when(F.col("n_uneven") > 0, "uneven spacing")
    return off.withColumn("warning", warning)


def sheared(stack: DataFrame, normal: g.Vec) -> DataFrame:
    """series_key, shear: whether consecutive slices move sideways by more than the limit."""
    w = Window.partitionBy("series_key").orderBy("k")
    step = tuple(F.col(c) - F.lag(c).over(w) for c in "xyz")
    moved = stack.select("series_key", *(s.alias(c) for s, c in zip(step, ("dx", "dy", "dz"), strict=True))).filter("dx is not null")
    d = tuple(F.col(c) for c in ("dx", "dy", "dz"))
    side = g.length(g.subtract(d, g.scale(normal, g.dot(d, normal))))
    return moved.groupBy("series_key").agg(F.bool_or(side > SHEAR).alias("shear"))


def best_partner(volumes: DataFrame) -> DataFrame:
    """active, partner, oblique: for each T1 or fat-saturated volume the best one of the other kind.

    Same non-empty frame; the closest angle wins, then most slices, then the smaller uid.
    ``volumes``: uid, kind, frame, nx/ny/nz normal columns (ax, ay, az), slices.
    """
    a = volumes.filter("kind in ('t1', 'fatsat') and frame <> ''")
    # series of one direction agree alike with any other: directions meet, each with the two series that come first
    face, order = ["kind", "frame", *AXES], [F.desc("slices"), "uid"]
    heads = first_of(a.groupBy(*face, "uid").agg(F.max("slices").alias("slices")), face, order, 2)
    b = heads.select(F.col("uid").alias("partner"), F.when(F.col("kind") == "t1", "fatsat").otherwise("t1").alias("kind"), "frame", *(F.col(c).alias("b" + c) for c in AXES), F.col("slices").alias("b_slices"))
    agree = F.round(F.abs(g.dot(tuple(F.col(c) for c in AXES), tuple(F.col("b" + c) for c in AXES))), 9)
    met = a.select(*face).distinct().join(b, ["kind", "frame"]).withColumn("agreement", agree)
    best = met.groupBy(*face, "partner").agg(F.max(F.struct("agreement", "b_slices")).alias("m")).select(*face, "partner", "m.*")
    order = [F.desc("agreement"), F.desc("b_slices"), "partner"]
    best = first_of(best, face, order, 2).select(*(F.col(c).alias("of_" + c) for c in face), "partner", "agreement", "b_slices")
    own = (a["kind"] == F.col("of_kind")) & (a["frame"] == F.col("of_frame"))
    for c in AXES:
        own = own & a[c].eqNullSafe(F.col("of_" + c))
    pairs = a.join(best, own).filter("uid <> partner")
    return first_of(pairs, ["uid"], order, 1).select(F.col("uid").alias("active"), "partner", "agreement", (F.col("agreement") < 0.99).alias("oblique"))


def first_of(rows: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("r") <= n).drop("r")


def pair_for(volumes: DataFrame, uid: str) -> DataFrame:
    """t1, fatsat, agreement, oblique: the pair that one series is shown with; no row if it has no partner."""
    of = volumes.filter(F.col("uid") == uid).select(F.col("frame").alias("f"))
    own = volumes.join(F.broadcast(of), F.col("frame") == F.col("f"), "left_semi")  # the series' own study only
    pair = best_partner(own).filter(F.col("active") == uid).join(volumes.select(F.col("uid").alias("active"), "kind"), "active")
    first, second = F.col("active"), F.col("partner")
    return pair.select(F.when(F.col("kind") == "t1", first).otherwise(second).alias("t1"), F.when(F.col("kind") == "t1", second).otherwise(first).alias("fatsat"), "agreement", "oblique")


def fusion_candidate(volumes: DataFrame, angle: float = 0.9) -> DataFrame:
    """The (kind, frame) group to fuse: two or more members, some pair at an angle, most members first."""
    known = volumes.filter("kind <> 'unknown' and frame <> ''")
    # series of one direction are at one angle to any other: directions meet, with the uids at either end
    one = known.groupBy("kind", "frame", *AXES).agg(F.min("uid").alias("low"), F.max("uid").alias("high"))
    other = one.select("kind", "frame", *(F.col(c).alias("o_" + c) for c in (*AXES, "low", "high")))
    apart = F.abs(g.dot(tuple(F.col(c) for c in AXES), tuple(F.col("o_" + c) for c in AXES))) < angle
    several = (F.col("low") != F.col("o_high")) | (F.col("high") != F.col("o_low"))  # not one series met with itself
    angled = one.join(other, ["kind", "frame"]).filter(apart & several).select("kind", "frame").distinct()
    groups = known.groupBy("kind", "frame").agg(F.count("*").alias("n"), F.min("uid").alias("first"))
    return groups.join(angled, ["kind", "frame"]).filter("n >= 2").orderBy(F.desc("n"), "first").limit(1).select("kind", "frame", "n", "first")


# The stack's warnings, by code.
MIXED, SIDEWAYS, STUCK, UNEVEN_STEPS = "mixed_orientation", "sideways", "not_advancing", "uneven_spacing"


def _vec(c: str | Column) -> g.Vec:
    return tuple(F.get(c, F.lit(n)) for n in range(3))


def volumes(images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Volumes, their ordered slices (with k), and rejected series (series_key, reason), of images with a series_key.

    The image of the smallest path gives a series its normal; slices follow their depth
    along it (equal to a millionth of a millimetre: the instance number, then the path).
    The first slice gives geometry and display. The step is the median gap; where slices
    do not advance or there is one only, the spacing that the image names. A series of
    unequal sizes or of several samples a pixel is rejected.
    """
    head = images.groupBy("series_key").agg(F.min_by(F.struct("row_axis", "col_axis"), "path").alias("h"), F.count_distinct("rows", "cols").alias("sizes"), F.max("samples").alias("most"))
    head = head.withColumn("normal", F.array(*g.normalize(g.cross(_vec("h.row_axis"), _vec("h.col_axis")))))
    reason = F.when(F.col("sizes") > 1, "slices differ in size").when(F.col("most") > 1, "several samples a pixel")
    rejected = head.select("series_key", reason.alias("reason")).filter("reason is not null")
    placed = images.join(head.filter(reason.isNull()).select("series_key", "normal"), "series_key").withColumn("depth", g.dot(_vec("position"), _vec("normal")))
    order = Window.partitionBy("series_key").orderBy(F.round("depth", 6), "instance_number", "path")
    stack = placed.withColumn("k", F.row_number().over(order) - 1).withColumn("gap", F.col("depth") - F.lag("depth").over(order))
    geometry = ["rows", "cols", "row_axis", "col_axis", "normal", "position", "row_spacing", "col_spacing", "between", "thickness", "slope", "intercept", "center", "width", "description", "modality", "series_number", "frame_uid", "signed"]
    first = stack.groupBy("series_key").agg(F.count("*").alias("n"), F.median("gap").alias("step"), *(F.min_by(c, "k").alias(c) for c in geometry))
    own = tuple(F.col("p.position")[n] - F.col("f.position")[n] for n in range(3))
    along = g.dot(own, _vec("f.normal"))
    aside = g.length(g.subtract(own, g.scale(_vec("f.normal"), along)))
    turned = F.abs(g.dot(g.normalize(g.cross(_vec("p.row_axis"), _vec("p.col_axis"))), _vec("f.normal")))
    seen = stack.alias("p").join(first.alias("f"), "series_key").groupBy("series_key").agg(F.bool_or(turned < TURN).alias("mixed"), F.bool_or(aside > SHEAR).alias("sideways"), F.count_if(F.abs(F.col("p.gap") - F.col("f.step")) > UNEVEN).alias("uneven"))
    named = F.coalesce("between", "thickness", F.lit(1.0))
    step = F.when((F.col("n") < 2) | (F.col("step") <= 0), named).otherwise(F.col("step"))
    stuck = (F.col("n") > 1) & (F.col("step") <= 0)
    warnings = F.array_compact(F.array(F.when(F.col("mixed"), MIXED), F.when(F.col("sideways"), SIDEWAYS), F.when(stuck, STUCK).when(F.col("uneven") > 0, UNEVEN_STEPS)))
    out = first.join(seen, "series_key").select(
        F.col("series_key").alias("volume_id"), F.array("cols", "rows", F.col("n").cast("int")).alias("dims"), F.array("col_spacing", "row_spacing", step).alias("spacing"), F.col("position").alias("origin"), F.array("row_axis", "col_axis", "normal").alias("axes"),
        "slope", "intercept", "center", "width", "signed", "description", "modality", "series_number", "frame_uid", "uneven", warnings.alias("warnings"),
    )
    return out, stack, rejected
