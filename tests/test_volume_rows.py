"""A volume's own row goes to its voxels: a join by volume alone would read a whole volume in one task."""

from pyspark.sql import functions as F

from voxelake.operators import histogram, resample, slabs


def sent(df):
    """Of each join of the plan, the outermost first, whether its right side is sent to the rows of its left."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return ["rightHint=(strategy=broadcast)" in line for line in plan.splitlines() if "Join " in line]


def voxels(spark):
    at = lambda n: (F.col("idx") / n % 4).cast("int")
    v = spark.range(64 * 4).select((F.col("id") % 4).cast("string").alias("volume_id"), F.floor(F.col("id") / 4).alias("idx"))
    return v.select("*", at(16).alias("k"), at(4).alias("j"), at(1).alias("i"), (F.col("idx") * 7 % 50).cast("int").alias("stored"))


def test_ranges_go_to_voxels(spark):
    assert sent(histogram.histogram(voxels(spark)))[0]
    assert sent(histogram.signals(voxels(spark)))[0]
    assert histogram.signals(voxels(spark)).count() == 256


def test_sizes_go_to_slices(spark):
    v = voxels(spark)
    assert sent(slabs.spread(v, slabs.grid_of(v), ["stored"]))[0]
    assert slabs.spread(v, slabs.grid_of(v), ["stored"]).count() == 16


def test_scales_go_to_reads(spark):
    v = voxels(spark)
    one = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)))
    volumes = slabs.grid_of(v).select("volume_id", "nx", "ny", "nz", one.alias("m"), F.array("sx", "sy", "sz").alias("spacing"))
    fused = resample.fuse(volumes, v, histogram.muscle_ranges(v), resample.plan_fusion(volumes))
    assert sent(fused)[:2] == [False, True]  # cells meet their reads by cell
    assert fused.agg(F.max("n_sources")).first()[0] == 4
