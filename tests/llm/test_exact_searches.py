"""Exact top-k search and hard negatives against plain loops over whole numbers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from voxelake.llm import blocks, exact, negatives

KINDS = "vec_id long, embedding array<double>, label int, score string, row int, block int"


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    near = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in near], rng.choice([0, 1, 2])) for i in range(240)]
    rows += [(i, None if i % 3 else [], 1) for i in range(300, 306)]
    rows += [(400, near, None), (None, near, 1), (500, [*near[:11], None], 1), (501, [*near[:11], math.nan], 1), (502, [*near[:11], math.inf], 0)]
    rows += [(600, [0.0] * 12, 1), (700, near, 2), (700, near, 2), (700, near, 1), (800, [1.5, 2.5, -0.1], 0), (801, [1.5, 2.5, 0.1], 0), (802, [1.2, 2.5, 0.1], 1)]
    rows += [(100 * i, near, i % 2) for i in range(20, 40)]  # many ties
    rows += [(4000, [3e14, 1e-9], 0), (4001, [3e14, 7.0], 0), (4002, [2.9e14, -7.0], 1), (4003, [1e300, 1.0], 1), (4100, [1e300, 2.0], 0), (4101, [5e307] * 2, 1)]
    rows += [(-100, near, -3), (-7, near, -3), (-8, near, 5)]
    return [(*r, "x", 1, 2) for r in rows]


def whole(rows: list[tuple], scale: int) -> list[tuple]:
    out = []
    for vec_id, v, label, *_ in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x * scale) for x in v):
            out.append((vec_id, [math.floor(x * scale) for x in v], label))
    return out


def score(a: list[int], b: list[int]) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True))))


def brute_top(rows: list[tuple], k: int = 10) -> Counter:
    own, out = whole(rows, 1024), Counter()
    for n, (q_id, q, _) in enumerate(own):
        if q_id % 100 == 0:
            found = sorted((-score(q, c), c_id) for m, (c_id, c, _) in enumerate(own) if m != n and len(c) == len(q))
            out.update((q_id, rank, c_id, -s) for rank, (s, c_id) in enumerate(found[:k], 1))
    return out


def brute_negatives(rows: list[tuple]) -> Counter:
    own, out = [(i, v, math.fmod(y + 1, 10) if i % 7 == 0 else y) for i, v, y in whole(rows, 256) if y is not None], Counter()
    for n, (q_id, q, label) in enumerate(own):
        if q_id % 100 == 0:
            all_ = [(-score(q, c), c_id, y) for m, (c_id, c, y) in enumerate(own) if m != n and len(c) == len(q)]
            for p, p_id, _ in sorted(x for x in all_ if x[2] == label)[:5]:
                found = sorted(x for x in all_ if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)
                out.update((q_id, p_id, rank, c_id, -p, -s) for rank, (s, c_id, _) in enumerate(found[:5], 1))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), KINDS).repartition(3)


@pytest.mark.parametrize("blocks_of", [1 << 22, 300, 12])
def test_odd_rows_equal_loops(odd, monkeypatch, blocks_of):
    monkeypatch.setattr(blocks, "block_count", lambda v: max(1, -(-v.count() * 12 // blocks_of)) if blocks_of > 12 else 40)
    assert Counter(tuple(r) for r in exact.search(odd).drop("query_row").collect()) == brute_top(odd_rows())
    assert Counter(tuple(r) for r in negatives.mine(odd, label=negatives.moved_label()).drop("anchor_row").collect()) == brute_negatives(odd_rows())


def test_few_and_no_rows(spark, odd):
    few = odd_rows()[:3]
    df = spark.createDataFrame(few, KINDS)
    assert Counter(tuple(r) for r in exact.search(df).drop("query_row").collect()) == brute_top(few)
    assert exact.search(odd.limit(0)).count() == 0 and negatives.mine(odd.limit(0)).count() == 0


def test_bounds_hold_at_every_level_and_leave_out_rows():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 33)), 25, axis=0) + rng.normal(size=(1000, 33)) * 0.05))
    for q in x[::97]:
        true = x @ q
        levels = zip(negatives.hierarchy(33, *negatives.summaries(x)), negatives.hierarchy(33, *negatives.summaries(q[None, :])), strict=True)
        widths = []
        for (size, m, d), (_, qm, qd) in levels:
            mid, reach = m @ (size * qm[0]), d @ qd[0] + 1e-6 * np.abs(true).max()
            assert (abs(true - mid) <= reach).all()
            widths.append(reach.mean())
        assert widths == sorted(widths, reverse=True) and len(widths) == 5
    import pyarrow as pa

    t = pa.table({"vec": x.tolist(), "vec_id": np.arange(1000), "row": np.arange(1000), "label": np.arange(1000) % 3, "dim": np.full(1000, 33)})
    (row,) = negatives.summed_block(33, t)
    block = negatives.Summed([dict(zip(("row", "vec_id", "head", "body", "tail"), row, strict=True)) | {"dim": 33}])
    left = [len(block.refine(q, np.arange(1000), [(-np.inf, np.inf)], 5)) for q in x[::97]]
    assert max(left) < 300


def test_postings_skip_zeros_of_sparse_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, 0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(30)], 0, "", 0, 0) for i in range(200)]
    got = exact.search(spark.createDataFrame(rows, KINDS), is_query="vec_id % 10 = 0", k=4).drop("query_row").collect()
    want = {q: sorted((-score(a, b), c) for c, b, _ in whole(rows, 1024) if c != q)[:4] for q, a, _ in whole(rows, 1024) if q % 10 == 0}
    assert {(r.query_id, r.rank): (-r.score, r.vec_id) for r in got} == {(q, n): x for q, found in want.items() for n, x in enumerate(found, 1)}
