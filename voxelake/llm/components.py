"""Connected components by alternating large-star and small-star rounds.

Everything stays distributed: a round is two aggregations (map-side combined, so
a hub costs one partial row per task) and two joins against a side with unique
keys. Hubs, nodes with more edges than ``HUB`` and than a millionth of all, are few by
that very bound: their minima go to the edges, so that no hub's edges meet in one
task; only the rest is joined by key. Each round is written to the shared folder;
one aggregation tells whether only stars are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.llm.common import materialize

HUB = 1000


def _with_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with the column m of ``least`` (u, m, n), joined by u; at most 2^20 hubs are sent, 16 MB."""
    if n_rows <= HUB:  # too few for a hub
        return rows.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > max(HUB, n_rows >> 20)).select("u", "m"))
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(least.select("u", "m"), "u"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.filter("v > u"), least, 2 * n).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = _with_least(down, least, n).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one: nothing is left to do."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child")).union(edges.select("b", F.lit(0)))
    return not ends.groupBy("n").agg(F.sum("child").alias("up"), F.min("child").alias("down")).filter("up > 1 or (up = 1 and down = 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns); component is the smallest node reached.

    Loops and repeated edges do no harm; nodes without edges are not listed; no
    edges give an empty result.
    """
    a, b = edges.columns
    ends = [F.col(c).cast("long") for c in (a, b)]
    now = materialize(edges.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).filter("a <> b").distinct(), "edges")
    while not _stars(now):
        n = now.count()
        large = materialize(_large_star(now, n).filter("a <> b").distinct(), "edges")
        now = materialize(_small_star(large, large.count()).filter("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
