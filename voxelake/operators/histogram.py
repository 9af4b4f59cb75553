"""Histogram quantiles and signal scales of volumes.

A volume becomes at most 1024 bins by one map-side-combined aggregation, whatever
its size; the windows that find quantiles run over bins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelake.functions.rules import MUSCLE_LEVEL
from voxelake.functions.scalar import half_up, to_signal
from voxelake.operators.slabs import per_volume

BINS = 1024
BODY_FLOOR, TISSUE_TOP = 0.12, 0.998  # fixed values of the muscle scale


def value_ranges(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("volume_id").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"))


def histogram(voxels: DataFrame, stride: int = 7) -> DataFrame:
    """volume_id, bin, n over every ``stride``-th voxel in storage order; over all of them with 1."""
    scale = F.try_divide(F.lit(float(BINS - 1)), F.col("hi") - F.col("lo"))
    bin_ = F.coalesce((F.col("stored") - F.col("lo")) * scale, F.lit(0.0))
    counted = voxels if stride == 1 else voxels.filter(F.col("idx") % stride == 0)
    return per_volume(counted, value_ranges(voxels)).select("volume_id", half_up(bin_).cast("int").alias("bin")).groupBy("volume_id", "bin").agg(F.count("*").alias("n"))


def _cumulated(bins: DataFrame) -> DataFrame:
    w = Window.partitionBy("volume_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("volume_id")))


def at_fraction(fraction: float) -> Column:
    """The first bin by which ``fraction`` of the counts are seen (bin 0 for none)."""
    return F.lit(0) if fraction <= 0 else F.min(F.when(F.col("upto") >= F.col("total") * fraction, F.col("bin")))


def percentile_ranges(voxels: DataFrame, low: float = 0.01, high: float = 0.995, stride: int = 7) -> DataFrame:
    """volume_id, low, high as fractions of the stored range; (0, 1) for a flat volume."""
    got = _cumulated(histogram(voxels, stride)).groupBy("volume_id").agg((at_fraction(low) / (BINS - 1)).alias("a"), (at_fraction(high) / (BINS - 1)).alias("b"))
    flat = F.col("hi") <= F.col("lo")
    return got.join(value_ranges(voxels), "volume_id").select("volume_id", F.when(flat, 0.0).otherwise(F.col("a")).alias("low"), F.when(flat, 1.0).otherwise(F.greatest("b", F.col("a") + 1e-4)).alias("high"))


def muscle_ranges(voxels: DataFrame, stride: int = 7) -> DataFrame:
    """volume_id, lo, hi (stored range), low, high: the scale on which muscle reads 0.3."""
    bins = _cumulated(histogram(voxels, stride))
    top = bins.groupBy("volume_id").agg(half_up(at_fraction(TISSUE_TOP) * BODY_FLOOR).alias("floor"))
    body = bins.join(top, "volume_id").filter("bin >= floor")
    w = Window.partitionBy("volume_id")
    seen = body.withColumn("seen", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("body", F.sum("n").over(w))
    median = seen.groupBy("volume_id").agg(F.min(F.when(F.col("seen") * 2 >= F.col("body"), F.col("bin"))).alias("median"))
    high = F.when(F.col("hi") <= F.col("lo"), 1.0).otherwise(F.greatest(F.col("median") / (BINS - 1) / MUSCLE_LEVEL, F.lit(1e-4)))
    return value_ranges(voxels).join(median, "volume_id").select("volume_id", "lo", "hi", F.lit(0.0).alias("low"), high.alias("high"))


def signals(voxels: DataFrame, stride: int = 7) -> DataFrame:
    """Voxels with ``signal``, the muscle-anchored value."""
    fraction = (F.col("stored") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    scaled = per_volume(voxels, muscle_ranges(voxels, stride))
    return scaled.withColumn("signal", to_signal(fraction, F.col("low"), F.col("high"))).drop("lo", "hi", "low", "high")
