"""Volumes as voxel tables, and the views of the driver's tables that stand for them.

The voxel contract: volume_id STRING, k, j, i INT, idx LONG (k*ny*nx + j*nx + i),
stored INT. Grids of 8 x 8 x n are read from the 64 numbers of each embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.functions.scalar import half_up

NX = NY = 8


def _grid(spark: SparkSession, sf_dir: str, volume_id: str, place, stored) -> DataFrame:
    """Voxels of one volume; ``place`` turns the array position into the in-slice position."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("q", "x"))
    p, x = place(F.col("q")), F.col("x").cast("double")
    return e.select(
        F.lit(volume_id).alias("volume_id"),
        F.col("vec_id").cast("int").alias("k"),
        F.floor(p / NX).cast("int").alias("j"),
        (p % NX).cast("int").alias("i"),
        (F.col("vec_id") * (NX * NY) + p).alias("idx"),
        half_up(stored(x)).cast("int").alias("stored"),
    )


def t1_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, "t1", lambda q: q, lambda x: (x + 1) * 2000)


def fatsat_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second sequence: the slice turned by half a turn, its signal steeper."""
    return _grid(spark, sf_dir, "fs", lambda q: NX * NY - 1 - q, lambda x: (x + 1) * (x + 1) * (x + 1) * (x + 1) * 500)


#: The same views as SQL (k, j, i, idx, stored).
T1_SQL = "t1 AS (SELECT CAST(vec_id AS INTEGER) AS k, CAST(p // 8 AS INTEGER) AS j, CAST(p % 8 AS INTEGER) AS i, vec_id * 64 + p AS idx, CAST(floor((CAST(embedding[p + 1] AS DOUBLE) + 1) * 2000 + 0.5) AS INTEGER) AS stored FROM embeddings, range(64) r(p))"
FS_SQL = "fs AS (SELECT CAST(vec_id AS INTEGER) AS k, CAST(p // 8 AS INTEGER) AS j, CAST(p % 8 AS INTEGER) AS i, vec_id * 64 + p AS idx, CAST(floor(y * y * y * y * 500 + 0.5) AS INTEGER) AS stored FROM (SELECT vec_id, p, CAST(embedding[64 - p] AS DOUBLE) + 1 AS y FROM embeddings, range(64) r(p)))"


def dims(voxels: DataFrame) -> DataFrame:
    """volume_id, nx, ny, nz of each volume."""
    return voxels.groupBy("volume_id").agg((F.max("i") + 1).alias("nx"), (F.max("j") + 1).alias("ny"), (F.max("k") + 1).alias("nz"))
