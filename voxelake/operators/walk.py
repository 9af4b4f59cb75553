"""Slice walks: depths, stop rules, and where a walk ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Stop limits of a walk (fixed values that results must share)."""

    max_slices: int = 32
    min_area: int = 24
    growth: float = 2.5
    shrink: float = 0.4
    drift: float = 3.0
    min_score: float = 0.5


def depths(seed: float, step: float, direction: int, low: float, high: float, most: int = 32) -> Column:
    """Depths of a walk from ``seed``, until the edge of (low, high) or ``most`` slices."""
    every = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.lit(seed) + n * F.lit(step * direction))
    return F.filter(every, lambda d: (d >= low) & (d <= high))


def cause(previous: Column, area: Column, score: Column, seed: Column, limits: Limits = Limits()) -> Column:
    """Why a slice stops the walk, the first rule that holds; null to go on."""
    return (
        F.when(area == 0, "vanished")
        .when(area < limits.min_area, "collapsed")
        .when((previous > 0) & (area > previous * limits.growth), "leaked")
        .when((previous > 0) & (area < previous * limits.shrink), "collapsed")
        .when((seed > 0) & (area > seed * limits.drift), "drifted")
        .when(score < limits.min_score, "low-score")
    )


def judged(slices: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Slices (walk_id, step, area, score) with the cause; step 0 is the seed."""
    w = Window.partitionBy("walk_id").orderBy("step")
    seed = F.first("area").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return slices.withColumn("cause", F.when(F.col("step") > 0, cause(F.lag("area").over(w), F.col("area"), F.col("score"), seed, limits)))


def walks(slices: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """walk_id, kept (slices before the stop, at most the limit), stop: the cause, edge or limit."""
    j = judged(slices, limits).filter("step > 0")
    ends = j.groupBy("walk_id").agg(F.min(F.when(F.col("cause").isNotNull() & (F.col("step") <= limits.max_slices), F.struct("step", "cause"))).alias("end"), F.max("step").alias("last"))
    kept = F.coalesce(F.col("end.step") - 1, F.least(F.col("last"), F.lit(limits.max_slices)))
    stop = F.coalesce("end.cause", F.when(F.col("last") < limits.max_slices, "edge").otherwise("limit"))
    return ends.select("walk_id", kept.alias("kept"), stop.alias("stop"))
