"""Walks as a stream: the batch's answers under any order of arrival, closed walks, late slices."""

import random

import pytest
from pyspark.sql import functions as F

from voxelake.operators import walk
from voxelake.streaming import streams, walks

KINDS = "walk_id long, step int, area double, score double, ts timestamp"


def slices(rng, n):
    rows = []
    for w in range(n):
        area = 100.0
        for step in range(rng.randint(1, 45)):
            rows.append((w, step, area, 0.9 if w % 4 == 0 else rng.choice([0.9] * 6 + [0.3]), 1_700_000_000 + 60 * step))
            area = 100.0 if w % 4 == 0 else rng.choice([area, area * 1.1, area * 0.9, area * 1.3, area * 0.8, area * 1.2] * 6 + [area * 2.6, area * 0.3, 0.0, 20.0])
    return rows


def stream(spark, tmp_path, batches):
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "walk_id long, step int, area double, score double, s long")
        df.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n:03}")
    return spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_arrival_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = slices(rng, 60)
    batch = walk.walks(spark.createDataFrame([r[:4] for r in rows], "walk_id long, step int, area double, score double"))
    want = {r.walk_id: (r.kept, r.stop) for r in batch.collect()}
    shuffled = rng.sample(rows + rows[::9], len(rows) + len(rows[::9]))  # some arrive twice
    arriving = stream(spark, tmp_path, [shuffled[i::5] for i in range(5)])
    got = streams.run_to_table(walks.walk_stream(arriving, late="1 day"), "update", ["walk_id"], "version")
    assert {r.walk_id: (r.kept, r.stop) for r in got.collect()} == want
    assert {"edge", "limit", "leaked", "collapsed", "vanished", "low-score"} <= {s for _, s in want.values()}


def test_what_comes_after_a_stop_and_after_the_patience(spark, tmp_path):
    t = 1_700_000_000
    first = [(1, 0, 100.0, 0.9, t), (1, 1, 100.0, 0.9, t), (1, 2, 0.0, 0.9, t), (2, 0, 100.0, 0.9, t), (2, 1, 90.0, 0.9, t), (2, 3, 30.0, 0.9, t)]
    after = [(1, 2, 100.0, 0.9, t), (1, 3, 100.0, 0.9, t)]  # the stop was final
    later = [(9, 0, 1.0, 0.9, t + 10 * 86400), (9, 1, 1.0, 0.9, t + 10 * 86400)]  # the watermark passes the patience: walk 2 is closed, its gap passed over
    last = [(9, 2, 1.0, 0.9, t + 20 * 86400)]
    got = streams.run_to_table(walks.walk_stream(stream(spark, tmp_path, [first, after, later, last]), late="1 hour", patience="2 days"), "update", ["walk_id"], "version")
    assert {r.walk_id: (r.kept, r.stop) for r in got.collect()} == {1: (1, "vanished"), 2: (1, "collapsed"), 9: (0, "collapsed")}


def test_scalar_rule_equals_the_column_rule(spark):
    rng = random.Random(3)
    rows = [(float(rng.choice([0, 10, 50, 100, 300])), float(rng.choice([0, 10, 23, 24, 50, 126, 251, 400])), rng.choice([0.2, 0.5, 0.9]), float(rng.choice([0, 40, 100]))) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, a double, s double, seed double")
    got = df.select(walk.cause(*(F.col(c) for c in ("p", "a", "s", "seed")))).collect()
    assert [r[0] for r in got] == [walks.cause(*r, walk.Limits()) for r in rows]


def test_long_logs_arrive_in_no_more_batches(spark, tmp_path, monkeypatch):
    """Many files of slices: the query takes each walk up as often as for few files."""
    import pandas as pd

    from voxelake.plans import masks, registry

    n = 40 * 300
    pd.DataFrame({"event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(n), "s"), "user_id": [i % 3 for i in range(n)], "event_type": "view", "value": 60.0, "props": "{}"}).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    put = masks.stored
    monkeypatch.setattr(masks, "stored", lambda df, name: put(df.repartition(40), name))
    batches = []
    run = streams.run_to_table
    monkeypatch.setattr(masks.streams, "run_to_table", lambda s, *how: (batches.append(s), run(s, *how))[1])
    monkeypatch.setattr(streams.uuid, "uuid4", lambda: type("U", (), {"hex": f"arrivals-{n}-{len(batches)}"})())
    got = registry.queries()["win3_stream"](spark, str(tmp_path)).collect()
    assert {(r.walk_id, r.kept, r.stop) for r in got} == {(w, 32, "limit") for w in range(3)}
    base = streams.shared_dir(spark).removeprefix("file://")
    from pathlib import Path

    assert 1 < len([p for p in Path(base).glob(f"voxelake-arrivals-{n}-1/state/commits/*") if p.name.isdigit()]) <= masks.ARRIVALS + 1
