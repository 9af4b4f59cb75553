"""Near-duplicate classes against all pairs: no link between different texts may be lost."""

import random

import numpy as np
import pytest

from voxelake.llm import prefix, simhash


def by_all_pairs(rows: list) -> dict:
    sets = {d: set(simhash.shingles(simhash.words_of(t), 5)) for d, t in rows}
    label = {d: d for d in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while True:
        old = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return label


def found(spark, rows: list) -> dict:
    return {r.doc_id: r.class_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def words(rng: random.Random, n: int) -> list:
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def test_groups_of_mutually_different_copies(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        base = words(rng, 240)
        for _ in range(8):  # each copy has its own edits: about half of the pairs reach 0.8
            copy = list(base)
            for at in rng.sample(range(240), rng.randint(2, 9)):
                copy[at] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    assert found(spark, rows) == by_all_pairs(rows)


def test_copies_with_an_appended_passage(spark):
    """Most of them lie beyond the radius of the bags' fingerprints."""
    rng = random.Random(12)
    rows = []
    for i in range(120):
        base = words(rng, 240)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + words(rng, rng.randint(20, 52))))]
    want = by_all_pairs(rows)
    far = [i for i in range(120) if want[2 * i + 1] == 2 * i and (simhash.bag_fingerprint(simhash.words_of(rows[2 * i][1])) ^ simhash.bag_fingerprint(simhash.words_of(rows[2 * i + 1][1]))).bit_count() > 6]
    assert len(far) > 20 and found(spark, rows) == want


def test_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(14)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64)
        a, b = (np.unique(np.r_[base[rng.random(len(base)) < rng.choice([0.9, 0.4])], rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64)]) for _ in "ab")
        assert prefix.apart(prefix.bitmap(a), prefix.bitmap(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


@pytest.mark.parametrize("tile", [4, 1024])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_join_proposes_all_pairs_of_a_common_start(spark, monkeypatch, tile, partitions):
    """Sets that share their hot elements, in large buckets that stretch over tasks, with and without an order by count."""
    monkeypatch.setattr(prefix, "TILE", tile)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(13)
    hot = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    sets = [np.unique(np.r_[hot[: rng.integers(20, 31)], rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(60)]
    own = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
    bits = spark.createDataFrame([(i, len(s), bytearray(prefix.bitmap(s))) for i, s in enumerate(sets)], "node long, n int, bits binary")
    try:
        for common in ([], [(int(x), 50) for x in hot.view(np.int64)]):
            rows = [(int(k), i, i, n, at) for i, s in enumerate(sets) for keys, n in [prefix.Order(common).prefix(s, 0.8)] for at, k in enumerate(keys)]
            found = prefix.buckets(spark.createDataFrame(rows, prefix.ROWS), 0.8).cache()
            members = found.join(bits.drop("n"), "node").cache()
            got = {(r.node, r["class"]) for r in found.filter("part = -2").collect()}
            first = 0
            for most in (1, 16, None):
                got |= {tuple(r) for r in prefix.pairs(members.filter("part >= 0" if not first else "part > -2"), 0.8, first, most).collect()}
                first += most or 0
            some = prefix.alike(spark.createDataFrame(sorted(got), "a long, b long"), bits, 0.8)
            assert want <= {tuple(r) for r in some.collect()} <= got and len(want) > 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_ids_lose_no_link_and_no_text(spark):
    rng = random.Random(15)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b, "x"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in simhash.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    kept = sorted(tuple(r) for r in simhash.deduplicate(df).collect())
    assert kept == sorted(rows[:2])  # B and B x are one class, A is one of its own
    rows = [(1, " ".join(a)), (2, " ".join(b)), (2, " ".join([*b, "x"])), (2, " ".join(a)), (3, " ".join(a)), (3, " ".join(a))]
    found_ = sorted((r.doc_id, r.class_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found_ == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 1), (3, 1)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2] and {" ".join(a)} < {r.text for r in kept}


def test_odd_rows_and_clashing_columns(spark):
    text = " ".join(words(random.Random(16), 50))
    rows = [(None, text), (None, text), (None, None), (7, None), (5, ""), (6, " "), (8, text + " end"), (9, "short"), (9, "short"), (None, "alone"), (10, "x " * 30_000)]
    df = spark.createDataFrame([(*r, i, "y") for i, r in enumerate(rows)], "doc_id long, text string, raw int, class string")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert got == sorted([("8", text + " end"), ("5", ""), ("9", "short"), ("None", "alone"), ("10", "x " * 30_000)])
    assert simhash.deduplicate(df.limit(0)).count() == 0
    assert {(r.doc_id, r.class_id) for r in simhash.near_duplicates(df.filter("doc_id is null")).collect()} == {(None, None)}
