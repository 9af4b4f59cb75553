"""Two-sequence tissue classification of voxel grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.functions import geometry as g
from voxelake.functions.rules import TISSUES, classify_pair
from voxelake.operators import resample, slabs
from voxelake.operators.histogram import signals
from voxelake.operators.slabs import Slab


def classify(t1: DataFrame, fatsat: DataFrame, study: list[str] = [], stride: int = 7) -> DataFrame:
    """``study``, volume_id, k, j, i, idx, tissue, confidence of T1 grids; the other sequence is read at the same voxel.

    ``study`` names the columns by which a T1 volume and its other sequence belong
    together; without any, either side is one volume. Scales count every ``stride``-th voxel.
    """
    a = signals(t1, stride).select(*study, "volume_id", "k", "j", "i", "idx", F.col("signal").alias("t1"))
    b = signals(fatsat, stride).select(*study, "idx", F.col("signal").alias("fs"))
    tissue, confidence = classify_pair(F.col("t1"), F.col("fs"))
    joined = a.join(b, [*study, "idx"], "left")
    return joined.select(*study, "volume_id", "k", "j", "i", "idx", "t1", "fs", tissue.alias("tissue"), confidence.alias("confidence"))


def classify_laid_out(t1: DataFrame, fatsat: DataFrame) -> DataFrame:
    """volume_id, idx, t1, fs, tissue, confidence of T1 slabs and the other sequence's, which bear the same volume_id.

    Both are spread tables with the field ``signal`` (see ``slabs`` and ``layout``). Tables that
    are laid out by slab meet without a shuffle.
    """

    def kernel(a: Slab, b: Slab | None) -> pa.Table:
        own = a.own(a.dense("signal", np.float64, np.nan))
        other = np.full(own.shape, np.nan)
        if b:
            theirs = b.own(b.dense("signal", np.float64, np.nan))
            same = tuple(slice(0, min(m, n)) for m, n in zip(own.shape, theirs.shape, strict=True))
            other[same] = theirs[same]
        t = a.table(a.own(a.present()), t1=own, fs=other)
        return t.select(["volume_id", "idx", "t1", "fs"])

    met = slabs.side_by_side(t1, fatsat, kernel, "volume_id string, idx long, t1 double, fs double").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("t1", "fs")})
    tissue, confidence = classify_pair(F.col("t1"), F.col("fs"))
    return met.select("volume_id", "idx", "t1", "fs", tissue.alias("tissue"), confidence.alias("confidence"))


def classify_grid(points: DataFrame, sequences: dict[str, tuple[DataFrame, DataFrame]], key: list[str]) -> DataFrame:
    """``key``, t1, fs, tissue, confidence at the patient points (px, py, pz) of any grid.

    ``sequences``: for t1 and fs the voxels and one volume row (volume_id, nx, ny, nz, m: affine).
    Each is read by eight neighbours on its own muscle scale; where one ends, the other
    decides alone, where both end, the tissue is unknown.
    """
    out = points.select(*key)
    for name, (voxels, volume) in sequences.items():
        inverse = g.invert_affine(tuple(F.get("m", F.lit(n)) for n in range(12)))
        own = volume.select("volume_id", "nx", "ny", "nz", F.array(*inverse).alias("inv"))  # one row
        voxel = g.apply_affine(tuple(F.get("inv", F.lit(n)) for n in range(12)), tuple(F.col(c) for c in ("px", "py", "pz")))
        placed = points.join(F.broadcast(own)).select(*key, "volume_id", "nx", "ny", "nz", *(v.alias(c) for v, c in zip(voxel, "xyz", strict=True)))
        field = signals(voxels).select("volume_id", "idx", F.col("signal").alias("stored"))
        out = out.join(resample.trilinear(placed, field, key).withColumnRenamed("value", name), key, "left")
    tissue, confidence = classify_pair(F.col("t1"), F.col("fs"))
    return out.select(*key, "t1", "fs", tissue.alias("tissue"), confidence.alias("confidence"))


def tally(classified: DataFrame) -> DataFrame:
    """tissue, n for every class, absent ones included: one pass, one row of counts."""
    counts = classified.agg(*(F.count_if(F.col("tissue") == t).alias(t) for t in TISSUES))
    return counts.unpivot([], list(TISSUES), "tissue", "n")
