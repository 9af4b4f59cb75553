"""Structured Streaming forms: running sessions, late answers, windowed activity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.operators import session
from voxelake.sources.shared import shared_dir


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder or file of events, with the schema of what lies there."""
    # written as a glob, a path may be a single file too
    glob = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob)


def run_to_table(stream: DataFrame, mode: str, keys: list[str], version: str) -> DataFrame:
    """Run a stream over what is there and give each key's row of the latest version.

    Micro-batches append to a folder all executors share; the reduction is a batch job.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/voxelake-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("append").parquet(f"{base}/rows")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{base}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")


def latest_sessions(spark: SparkSession, path: str) -> DataFrame:
    return run_to_table(session.fold_stream(session.from_events(events(spark, path))), "update", ["session_id"], "n_events")


def activity(spark: SparkSession, path: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and distinct answers a window, late rows accepted up to the watermark."""
    s = events(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = s.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))
    return run_to_table(w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "newest"), "update", ["start", "event_type"], "n")
