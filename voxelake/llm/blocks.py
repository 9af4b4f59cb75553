"""Integer vectors dealt into blocks, and queries brought to every block: exact searches.

The vectors that take part are written once, each row with a number of its own. They
are dealt round robin into blocks of equal size, whatever their ids, and each block
is turned into rows of some index. The queries, a stated part of all rows, go to each
block, as an exhaustive search demands; the blocks themselves are never copied. A task
streams over a block: first its index rows, then the queries, so that it holds one
block at a time.

Components are floored after scaling and kept as whole doubles. Sums are exact: as
doubles where none can reach 2^53, as Python integers where one could.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.llm.common import materialize

EXACT = float(1 << 53)
#: Rows of an index (kind 0) and queries (kind 1), as a block's task reads them.
ROW = "block int, kind int, dim int, row long, vec_id long, head binary, body binary, tail binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def numbered(rows: DataFrame, scale: int, vec_id: str, vector: str, **more: Column) -> DataFrame:
    """row, vec_id, dim, vec (scaled doubles) and ``more`` of the rows that take part, written.

    Rows without an id, and vectors null or with null or non-finite components (scaled
    ones too), take no part; vectors of every dimension do.
    """
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale)))
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("vec"), *(c.alias(n) for n, c in more.items()))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine)
    return materialize(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("vec").alias("dim"), "vec", *more), "vectors")


def block_count(vectors: DataFrame, least: int = 1 << 18, most: int = 1 << 22) -> int:
    """Blocks of at most about ``most`` components; smaller ones, down to ``least``, where that keeps all cores busy."""
    total = vectors.agg(F.sum(F.greatest("dim", F.lit(1)).cast("long"))).first()[0] or 0
    return max(1, -(-total // most), min(-(-total // least), 4 * vectors.sparkSession.sparkContext.defaultParallelism))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension, floored, as rows of whole doubles."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])] or [np.empty(0)])
    return np.floor(flat.astype(np.float64)).reshape(len(column), -1) if len(flat) else np.empty((len(column), 0))


def by_dimension(t: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    for d in pc.unique(t["dim"]).to_pylist():
        yield d, t.filter(pc.equal(t["dim"], d))


def records(rows: list[tuple]) -> pa.RecordBatch:
    """Tuples in the order of ``ROW`` as one batch."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def dealt(vectors: DataFrame, n: int, index: Callable[[int, pa.Table], Iterator[tuple]]) -> DataFrame:
    """The index rows (``ROW``) of ``n`` blocks; ``index`` gives a dimension's (row, vec_id, head, body, tail) in a block."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId(), list(batches)
        if held:
            for d, t in by_dimension(pa.Table.from_batches(held)):
                for row in index(d, t):
                    yield records([(block, 0, d, *row)])

    return vectors.repartition(n).mapInArrow(post, ROW)


def to_each_block(queries: DataFrame, n: int, sparse: Callable[[int, pa.Table], Iterator[tuple]]) -> DataFrame:
    """The query rows (``ROW``), each for every block; ``sparse`` gives (row, vec_id, head, body, tail) of a dimension's queries."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t in by_dimension(pa.Table.from_batches([b])):
                yield records([(0, 1, d, *row) for row in sparse(d, t)])

    return queries.mapInArrow(ask, ROW).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(NAMES)


def meet(index: DataFrame, queries: DataFrame, n: int, load: Callable[[list[dict]], Any], answer: Callable[[Any, dict], Iterator[tuple]], out: str, kinds: list[pa.DataType]) -> DataFrame:
    """What ``answer`` gives for each query and each block's ``load``ed index rows of the query's dimension."""
    names = [c.split()[0] for c in out.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, raw, loaded = -1, {}, {}
        for b in batches:
            found = []
            for r in b.to_pylist():
                if r["block"] != block:
                    block, raw, loaded = r["block"], {}, {}
                d = r["dim"]
                if r["kind"] == 0:
                    raw.setdefault(d, []).append(r)
                elif d in raw or d in loaded:
                    if d not in loaded:
                        loaded[d] = load(raw.pop(d))
                    found += answer(loaded[d], r)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return index.unionByName(queries).repartitionById(n, "block").sortWithinPartitions("block", "kind").mapInArrow(scan, out)


def whole(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers."""
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def as_long(score: float | int) -> int:
    """A score as a long; what does not fit is the nearest long."""
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, largest first, ties to the smaller id, by partition selection."""
    at = np.arange(len(score))
    if score.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: (-score[i], ids[i]))[:k], dtype=np.int64)
    if len(score) > k:  # ties at the edge stay until ids decide
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]
