"""The permutation index at many regions: recall, and rows that travel."""

import numpy as np
from pyspark.sql import functions as F

from voxelake.llm import ann


def table(spark, n, dim=16, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4), x


def test_recall_over_twenty_regions(spark):
    """Unstructured vectors in twenty regions and more: what calibration and reranking leave out is little."""
    df, x = table(spark, 5000)
    how = dict(pivots=128, block=240, length=48)
    known = ann.spaces(ann.usable(df, "vec_id", "embedding"), pivots=128, sample=2048, block=240, is_query="vec_id % 20 = 0")
    assert known[16].regions == 21
    got = ann.search(df, **how).cache()
    rate = ann.recall(got, df, tried=250)
    hit = 0
    for q, g in got.toPandas().groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert rate > 0.9 and abs(hit / 5000 - rate) < 1e-9  # all 250 queries were tried
    assert ann.recall(got.filter("rank <= 10"), df, tried=250) < 0.55
    assert ann.recall(got.limit(0), df, tried=10) == 0


def test_regions_may_outnumber_pivots(spark):
    df, _ = table(spark, 2000)
    known = ann.spaces(ann.usable(df, "vec_id", "embedding"), pivots=16, sample=64, block=20, is_query="vec_id % 20 = 0")
    assert len(known[16].pivots) == 16 and 50 < known[16].regions <= 100
    assert ann.search(df, pivots=16, sample=64, block=20, length=8).count() == 100 * 20


def test_rows_of_the_index_travel_once(spark):
    """Ten times the queries: the same rows of the index, and query rows in proportion to them."""
    df, _ = table(spark, 3000)

    def travelled(is_query):
        out = ann.search(df, pivots=64, block=300, length=16, is_query=is_query)
        out.write.format("noop").mode("overwrite").save()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "CartesianProduct" not in plan
        return out.select("query_id").distinct().count()

    assert travelled("vec_id % 100 = 0") * 10 == travelled("vec_id % 10 = 0")
    shards = ann.search(df, pivots=64, block=300, length=16).groupBy("query_id").agg(F.count("*").alias("n"))
    assert shards.filter("n <> 20").count() == 0
