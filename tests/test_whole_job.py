"""Results that stay whole: fused grids are as fine at any size, the scales of two studies count every voxel."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.functions import rules
from voxelake.operators import histogram, resample
from voxelake.plans import volumes


def test_fusion_keeps_the_finest_step_of_large_volumes(spark):
    """Over 16 million cells: the grid of agg14's SQL, which has no other step for them."""
    lit = lambda m: F.array(*(F.lit(float(x)) for x in m))
    volumes = spark.range(2).select(
        F.col("id").cast("string").alias("volume_id"),
        *(F.lit(n).alias(c) for c, n in (("nx", 8), ("ny", 8), ("nz", 200_000))),
        F.when(F.col("id") == 0, lit((1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0))).otherwise(lit((1, 0, 0, 0.5, 0, 1, 0, 0.25, 0, 0, 1.25, 1))).alias("m"),
        F.when(F.col("id") == 0, lit((1, 1, 1))).otherwise(lit((1, 1, 1.25))).alias("spacing"),
    )
    assert resample.plan_fusion(volumes) == {"dims": [9, 9, 250_001], "step": 1.0, "origin": [-0.5, -0.5, -0.5]}
    assert resample.plan_fusion(volumes, spacing=2.0)["dims"] == [5, 5, 125_001]


def test_bins_are_those_of_the_sql(spark):
    """Places on the border of two bins: the product with 1023 / span rounds other than the quotient."""
    rows = [(str(span), n, n) for span in (54, 108, 114, 210, 246) for n in range(span + 1)]
    voxels = spark.createDataFrame(rows, "volume_id string, idx long, stored int")
    got = {(r.volume_id, r.bin, r.n) for r in histogram.histogram(voxels, 1).collect()}
    sql = "SELECT span, CAST(floor(s * (1023.0 / span) + 0.5) AS INTEGER) AS bin, count(*) AS n FROM (SELECT span, unnest(range(span + 1)) AS s FROM (VALUES (54), (108), (114), (210), (246)) t(span)) GROUP BY 1, 2"
    assert got == {(str(v), b, n) for v, b, n in duckdb.sql(sql).fetchall()}


def of_study(k, p):
    """Study and place in it of a voxel of the common stack."""
    return ("b", k // 3 * 64 + p) if k % 3 == 0 else ("a", (k - k // 3 - 1) * 64 + p)


@pytest.fixture(scope="module")
def bright_sevenths(tmp_path_factory, spark):
    """A folder with 30 slices of which every seventh voxel of a T1 study is bright, and their tissue by loops over all voxels."""
    folder = str(tmp_path_factory.mktemp("sevenths"))
    rng = np.random.default_rng(6)
    a = rng.uniform(-0.95, 0.2, (30, 64)).astype(np.float32)
    for k, p in np.ndindex(a.shape):
        if of_study(k, p)[1] % 7 == 0:
            a[k, p] = rng.uniform(0.6, 0.95)
    spark.createDataFrame([(k, [float(x) for x in a[k]]) for k in range(30)], "vec_id long, embedding array<float>").write.parquet(folder + "/embeddings.parquet")
    y = a.astype(np.float64) + 1
    signal = {}
    for name, values in (("t1", y * 2000), ("fs", (y * y * y * y * 500)[:, ::-1])):
        for study in "ab":
            at = [(k, p) for k, p in np.ndindex(a.shape) if of_study(k, p)[0] == study]
            stored = np.floor(np.array([values[x] for x in at]) + 0.5)
            low, span = stored.min(), np.ptp(stored)
            bins = np.sort(np.floor((stored - low) * (1023.0 / span) + 0.5))
            top = bins[np.flatnonzero(np.arange(1, len(bins) + 1) >= len(bins) * 0.998)[0]]
            body = bins[bins >= np.floor(top * 0.12 + 0.5)]
            high = max(body[(len(body) + 1) // 2 - 1] / 1023 / 0.3, 1e-4)
            for x, s in zip(at, stored, strict=True):
                signal[name, *of_study(*x)] = float(np.clip((s - low) / span / high, 0, 1))
    rows = [(study, n, v, signal["fs", study, n]) for (name, study, n), v in signal.items() if name == "t1"]
    tissue, confidence = rules.classify_pair(F.col("t1"), F.col("fs"))
    want = spark.createDataFrame(rows, "study string, idx long, t1 double, fs double").select("study", "idx", tissue.alias("tissue"), confidence.alias("confidence"))
    return folder, {(r.study, r.idx): (r.tissue, pytest.approx(r.confidence, abs=2e-6)) for r in want.collect()}


def test_laid_out_scales_count_every_voxel(spark, bright_sevenths):
    folder, want = bright_sevenths
    assert {(r.volume_id, r.idx): (r.tissue, r.confidence) for r in volumes.join1_laid_out(spark, folder).collect()} == want


def test_scales_of_two_studies_count_every_voxel(spark, bright_sevenths):
    folder, want = bright_sevenths
    assert {(r.volume_id.removesuffix(" t1"), r.idx): (r.tissue, r.confidence) for r in volumes.join1_two(spark, folder).collect()} == want
