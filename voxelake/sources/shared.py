"""Durable intermediates in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a temporary folder, removed at exit."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _local[app] = tempfile.mkdtemp(prefix="voxelake-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: lineage is cut durably."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def stored(df: DataFrame, name: str) -> str:
    """The path in the shared folder to which ``df`` was written as Parquet."""
    path = f"{shared_dir(df.sparkSession)}/voxelake-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return path
