"""Hard negatives by segment summaries: bounds of inner products, refined segment by segment.

A vector is cut into segments of equal length; of each the mean and the deviation (the
norm of what is left without the mean) are stored. The product of two segments lies
within length * mean * mean, plus or minus deviation * deviation, and these sum to
bounds of the whole score. Two segments' summaries make their parents', so that the
bounds are refined from one segment to the finest ones: at every level a row stays
only if its bounds still reach one of the query's windows and the ``k`` best that are
known to lie in it: those that the bounds place there, and a few of the likeliest, which
are scored at once. What is left is scored exactly, in whole numbers.

Positives are the best of an anchor's own label, in an open window. Negatives are the
best of other labels in a window for each positive's score. Both searches read the
blocks of ``blocks``, rows sorted by label; each task keeps the best of its block, and
they are merged.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; vectors of different dimensions don't meet; rows that repeat
an id are anchors, positives and negatives of their own, only an anchor's own row is
not its positive; ties go to the smaller id; a negative score of a positive leaves no
room for negatives; scores beyond a long are its nearest value; fewer rows than wanted
are all returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelake.llm import blocks
from voxelake.llm.common import materialize

FOUND = "query_row long, query_id long, most long, vec_id long, score long"
KINDS = [pa.int64()] * 5
TYPES = {2: np.int16, 4: np.int32, 8: np.float64}
#: Rounding of single-precision summaries, as a share of the product of both norms.
SLACK = 4e-6


def edges(dim: int) -> np.ndarray:
    """Where the finest segments begin and end: a power of two of them, of two components or more."""
    parts = 1
    while dim // (2 * parts) >= 2:
        parts *= 2
    return np.arange(parts + 1) * dim // parts


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each row's finest segments."""
    cut = edges(x.shape[1])
    means, devs = (np.zeros((len(x), len(cut) - 1)) for _ in range(2))
    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a:
            means[:, s] = x[:, a:b].mean(axis=1)
            devs[:, s] = np.linalg.norm(x[:, a:b] - means[:, s : s + 1], axis=1)
    return means, devs


def hierarchy(dim: int, means: np.ndarray, devs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lengths, means, deviations) of every level, one segment first."""
    out = [(np.diff(edges(dim)).astype(np.float64), means, devs)]
    while len(out[0][0]) > 1:
        size, m, d = out[0]
        (n1, n2), (m1, m2), (d1, d2) = ((a[..., ::2], a[..., 1::2]) for a in (size, m, d))
        both = n1 + n2
        mean = (n1 * m1 + n2 * m2) / both
        out.insert(0, (both, mean, np.sqrt(d1**2 + d2**2 + n1 * (m1 - mean) ** 2 + n2 * (m2 - mean) ** 2)))
    return out


def summed_block(dim: int, t: pa.Table) -> Iterator[tuple]:
    """One index row: ids, row numbers and labels; components in as few bytes as hold them; the finest summaries."""
    label = t["label"].to_numpy()
    order = np.argsort(label, kind="stable")
    x = blocks.matrix(t["vec"])[order]
    top = np.abs(x).max(initial=0.0)
    kind = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    head = np.stack([t["vec_id"].to_numpy()[order], t["row"].to_numpy()[order], label[order]])
    with np.errstate(over="ignore", invalid="ignore"):
        yield len(x), kind, head.tobytes(), x.astype(TYPES[kind]).tobytes(), np.stack(summaries(x)).astype(np.float32).tobytes()


def labelled(dim: int, t: pa.Table) -> Iterator[tuple]:
    """Each query's components, label, and the scores that its negatives must not pass."""
    most = t["most"].to_pylist() if "most" in t.column_names else [[]] * len(t)
    for q, row, vec_id, label, m in zip(blocks.matrix(t["vec"]), t["row"].to_pylist(), t["vec_id"].to_pylist(), t["label"].to_pylist(), most, strict=True):
        yield row, vec_id, q.tobytes(), np.int64(label).tobytes(), np.array(m, dtype=np.int64).tobytes()


class Summed:
    """One block's vectors of one dimension, by label, with their summaries."""

    def __init__(self, rows: list[dict]):
        (r,) = rows
        n, dim = r["row"], r["dim"]
        self.x = np.frombuffer(r["body"], dtype=TYPES[r["vec_id"]]).reshape(n, dim)
        self.ids, self.rows, self.labels = np.frombuffer(r["head"], dtype=np.int64).reshape(3, n)
        self.top = np.abs(self.x).max(initial=0) * 1.0 if dim else 0.0
        means, devs = np.frombuffer(r["tail"], dtype=np.float32).reshape(2, n, -1)
        self.levels = hierarchy(dim, means, devs)
        size, m, d = self.levels[0]
        with np.errstate(over="ignore"):
            self.norms = np.sqrt(size[0] * m[:, 0].astype(np.float64) ** 2 + d[:, 0].astype(np.float64) ** 2)

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())

    def refine(self, q: np.ndarray, at: np.ndarray, windows: list[tuple[float, float]], k: int) -> np.ndarray:
        """Those of the rows ``at`` that may be among the ``k`` best of a window (least, most)."""
        floors = [low for low, _ in windows]
        slack = SLACK * np.linalg.norm(q) * self.norms
        means, devs = summaries(q[None, :])
        for (size, m, d), (_, qm, qd) in zip(self.levels, hierarchy(len(q), means, devs), strict=True):
            if len(at) <= k:
                break
            mid, reach = m[at] @ (size * qm[0]), d[at] @ qd[0] + slack[at]
            lower, upper = mid - reach, mid + reach
            keep = np.zeros(len(at), dtype=bool)
            for w, (_, high) in enumerate(windows):
                likely = np.where(mid <= high, mid, -np.inf)
                likely = at[np.argpartition(likely, len(at) - k - 1)[len(at) - k - 1 :]]
                tried = self.x[likely].astype(np.float64) @ q
                for known in (lower[upper <= high], tried[tried <= high]):
                    if len(known) >= k:
                        floors[w] = max(floors[w], np.partition(known, len(known) - k)[len(known) - k])
                keep |= (upper >= floors[w]) & (lower <= high)
            at = at[keep]
        return at

    def best(self, q: np.ndarray, at: np.ndarray, windows: list[tuple[float, float]], k: int) -> Iterator[tuple[int, int, int]]:
        """(window, id, score) of the ``k`` best of the rows ``at`` in each window, ties to the smaller id."""
        if len(q) * self.top * np.abs(q).max(initial=0.0) < blocks.EXACT:
            at = self.refine(q, at, windows, k)
            score = self.x[at].astype(np.float64) @ q
        else:
            score = np.array([blocks.as_long(s) for s in (blocks.whole(self.x[at].astype(np.float64)) * blocks.whole(q)).sum(axis=1)], dtype=object)
        for w, (low, high) in enumerate(windows):
            inside = np.flatnonzero((score >= low) & (score <= high))
            for i in inside[blocks.best(score[inside], self.ids[at[inside]], k)].tolist():
                yield w, int(self.ids[at[i]]), int(score[i])


def mine(
    rows: DataFrame,
    *,
    is_anchor: str = "vec_id % 100 = 0",
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row.

    For every anchor and each of its ``positives`` best rows of its label, the
    ``negatives`` best rows of other labels whose score is between ``least_percent`` and
    100 percent of the positive's.
    """

    def alike(block: Summed, q: dict) -> Iterator[tuple]:
        a, b = block.of_label(int(np.frombuffer(q["body"], dtype=np.int64)[0]))
        at = np.arange(a, b)
        at = at[block.rows[at] != q["row"]]
        for _, i, s in block.best(np.frombuffer(q["head"]), at, [(-np.inf, np.inf)], positives):
            yield q["row"], q["vec_id"], None, i, s

    def unlike(block: Summed, q: dict) -> Iterator[tuple]:
        a, b = block.of_label(int(np.frombuffer(q["body"], dtype=np.int64)[0]))
        most = np.frombuffer(q["tail"], dtype=np.int64).tolist()
        windows = [(-(-least_percent * m // 100), m) for m in most]
        at = np.concatenate([np.arange(a), np.arange(b, len(block.ids))])
        for w, i, s in block.best(np.frombuffer(q["head"]), at, windows, negatives):
            yield q["row"], q["vec_id"], most[w], i, s

    label = F.col(label) if isinstance(label, str) else label
    vectors = blocks.numbered(rows.filter(label.isNotNull()), scale, vec_id, vector, label=label.cast("long"))
    n = blocks.block_count(vectors)
    index = materialize(blocks.dealt(vectors, n, summed_block), "segments")
    anchors = vectors.filter(is_anchor)
    best = lambda by, name, k: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")).alias(name)
    found = blocks.meet(index, blocks.to_each_block(anchors, n, labelled), n, Summed, alike, FOUND, KINDS)
    first = found.select("*", best(["query_row"], "place", positives)).filter(F.col("place") <= positives)
    first = materialize(first.select("query_row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("most")), "positives")
    asked = first.filter("most >= 0").groupBy(F.col("query_row").alias("row")).agg(F.collect_set("most").alias("most"))  # no more than there are positives
    found = blocks.meet(index, blocks.to_each_block(anchors.join(asked, "row"), n, labelled), n, Summed, unlike, FOUND, KINDS)
    hard = found.select("*", best(["query_row", "most"], "rank", negatives)).filter(F.col("rank") <= negatives)
    return first.join(hard, ["query_row", "most"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("most").alias("positive_score"), F.col("score").alias("negative_score"), F.col("query_row").alias("anchor_row")
    )


def moved_label() -> Column:
    """The label that the query fixes: of every seventh id the next one."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


#: Whole tables of 64 components at sf0.01; every pair of an anchor and a row is formed.
ORACLE = """
with own as (
  select row_number() over () as r, cast(vec_id as bigint) as vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.r as r, q.vec_id as anchor_id, c.r as c, c.vec_id as vec_id, q.label = c.label as alike,
    cast(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) as score
  from own q join own c on q.r <> c.r and len(q.v) = len(c.v)
  where q.vec_id % 100 = 0
), positive as (
  select * from (select *, row_number() over (partition by r order by score desc, vec_id) as place from pairs where alike) where place <= 5
), negative as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.r, p.c order by n.score desc, n.vec_id) as rank
  from positive p join pairs n on n.r = p.r and not n.alike and 80 * p.score <= 100 * n.score and n.score <= p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negative where rank <= 5
"""
