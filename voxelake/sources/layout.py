"""Volumes stored for the joins that read them: tables bucketed by (volume_id, slab).

A written table has a row for every slice of every slab, the slices of its halo included
(see ``operators.slabs``). What reads neighbours, or the same slab of another sequence that
is laid out alike, finds both sides of its join in the same bucket: no row is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from voxelake.sources.shared import shared_dir

KEY = ("volume_id", "slab")


def lay_out(rows: DataFrame, name: str = "slabs", buckets: int | None = None) -> DataFrame:
    """Write spread ``rows`` as a bucketed table in the shared folder, and read it.

    One shuffle brings each bucket into one task, so that it is one file. Tables that are
    to meet need the same number of ``buckets``, by default that of shuffle partitions;
    it should grow with the table, as a bucket is what one task reads.
    """
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/voxelake-{table}"
    rows.repartition(n, *KEY).write.bucketBy(n, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)
    return spark.table(table)
