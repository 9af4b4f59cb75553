"""Exact top-k search by inner product: exhaustive accumulation, term at a time.

A component is a term. Each block of candidates (``blocks``) has a posting list for each
term that any of its vectors holds: rows and weights, without zeros. A query is a
sparse row of terms and weights; for each of its terms in turn the weighted postings
are scattered into a dense array of scores, one for each candidate of the block. The
``k`` largest are selected by partition, and the blocks' selections are merged.

Defined results: vectors null or with null or non-finite components, and rows without
an id, take no part; empty and zero vectors do, with scores of zero; vectors of
different dimensions don't meet; rows that repeat an id are queries and candidates of
their own, and only a query's own row is no candidate of it; ties go to the smaller id;
scores beyond a long are its nearest value; fewer candidates than wanted are all
returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelake.llm import blocks

OUT = "query_row long, query_id long, vec_id long, score long"


def postings(dim: int, t: pa.Table) -> Iterator[tuple]:
    """A row of ids and row numbers, then for each term the rows that hold it and their weights."""
    x = blocks.matrix(t["vec"])
    yield -1, 0, t["vec_id"].to_numpy().tobytes(), t["row"].to_numpy().tobytes(), b""
    for term in range(dim):
        rows = np.flatnonzero(x[:, term])
        if len(rows):
            yield term, 0, rows.astype(np.int32).tobytes(), x[rows, term].tobytes(), b""


def sparse_rows(dim: int, t: pa.Table) -> Iterator[tuple]:
    """Terms and weights of each query, without zeros."""
    for q, row, vec_id in zip(blocks.matrix(t["vec"]), t["row"].to_pylist(), t["vec_id"].to_pylist(), strict=True):
        terms = np.flatnonzero(q)
        yield row, vec_id, terms.astype(np.int32).tobytes(), q[terms].tobytes(), b""


class Postings:
    """The posting lists of one block."""

    def __init__(self, rows: list[dict]):
        head = next(r for r in rows if r["row"] < 0)
        self.ids, self.rows = (np.frombuffer(head[c], dtype=np.int64) for c in ("head", "body"))
        self.lists = {r["row"]: (np.frombuffer(r["head"], dtype=np.int32), np.frombuffer(r["body"])) for r in rows if r["row"] >= 0}
        self.top = max((np.abs(w).max() for _, w in self.lists.values()), default=0.0)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Inner product of every row with the query, summed term by term."""
        exact = len(terms) * self.top * np.abs(weights).max(initial=0.0) < blocks.EXACT
        dense = np.zeros(len(self.ids)) if exact else np.zeros(len(self.ids), dtype=object)
        for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
            rows, held = self.lists.get(term, (None, None))
            if rows is None:
                continue
            gain = weight * held if exact else int(weight) * blocks.whole(held)
            if len(rows) == len(dense):
                dense += gain
            else:
                dense[rows] += gain
        return dense


def search(rows: DataFrame, *, is_query: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row that ``is_query``; query_row tells rows of one id apart."""

    def answer(block: Postings, q: dict) -> Iterator[tuple]:
        score = block.scores(np.frombuffer(q["head"], dtype=np.int32), np.frombuffer(q["body"]))
        at = blocks.best(score, block.ids, k + 1)
        at = at[block.rows[at] != q["row"]][:k]
        return ((q["row"], q["vec_id"], i, blocks.as_long(s)) for i, s in zip(block.ids[at].tolist(), score[at].tolist(), strict=True))

    vectors = blocks.numbered(rows, scale, vec_id, vector)
    n = blocks.block_count(vectors)
    asked = blocks.to_each_block(vectors.filter(is_query), n, sparse_rows)
    found = blocks.meet(blocks.dealt(vectors, n, postings), asked, n, Postings, answer, OUT, [pa.int64()] * 4)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


#: Whole tables of 64 components at sf0.01; every pair of a query and a row is formed.
ORACLE = """
with own as (
  select row_number() over () as r, cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.r as r, q.vec_id as query_id, c.vec_id as vec_id,
    cast(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) as score
  from own q join own c on q.r <> c.r and len(q.v) = len(c.v)
  where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from pairs)
where rank <= 10
"""
