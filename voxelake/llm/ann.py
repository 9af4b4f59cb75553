"""Nearest neighbours by a permutation index (inner product).

A vector is represented by its nearest pivots in order. The permutations are
posted in pivot inverted files (pivot -> vectors holding it, with the place it has
there). A query walks the files of its own nearest pivots and accumulates the
footrule distance of the truncated permutations: a pivot that both hold at places
i and j brings them 2 * (length - max(i, j)) closer. The nearest by footrule, ties
included, are reranked on the original vectors in double precision.

The index is sharded by region: a vector's region is the nearest of the region pivots,
about one region for every ``block`` vectors, up to ``most_regions``; a larger region is
dealt out to several shards, each with its own inverted files. A query visits its
nearest regions only. How many is measured at every size: a bounded sample of queries is
compared with all rows, and as many regions are visited as hold ``within`` of their true
neighbours. A row of the index travels once, a query to each shard that it visits; a
task reads a shard, then streams over the queries that visit it. A query's best of each
shard are merged. How much is left out is up to the data: unstructured vectors leave little.
``recall`` measures the final answer against all rows.

Largest inner product is nearest neighbour after one more coordinate brings all
vectors to the norm of the longest; pivots see vectors that way.

Defined results: vectors null, empty, zero, or with null or non-finite components
take no part; vectors of different dimensions are searched apart, each dimension by
its own pivots; scores are summed in the components' order, wherever a vector lies,
so that equal vectors tie; ties go to the smaller id; a repeated id is no candidate
of itself; fewer candidates than wanted are all returned, down to none; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelake.llm.common import materialize

OUT = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec (array of double) of the vectors that take part, of any dimension."""
    vec = F.col(vector).cast("array<double>")
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id is not null and vec is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(fine & F.exists("vec", lambda x: x != 0))


def choose_pivots(sample: np.ndarray, most: int, alike: float = 0.95) -> np.ndarray:
    """Up to ``most`` rows of a sample of unit vectors, no two of them alike."""
    chosen, n = np.empty((min(most, len(sample)), sample.shape[1])), 0
    for v in sample:
        if n == len(chosen):
            break
        if not n or (chosen[:n] @ v).max() <= alike:
            chosen[n] = v
            n += 1
    return chosen[:n]


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors divided by the longest norm, with the coordinate that makes them unit vectors."""
    y = x / longest
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))[:, None]])


def permutations(units: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each row, nearest first, ties to the smaller pivot number."""
    out = np.empty((len(units), length), dtype=np.int16)
    for i in range(0, len(units), 2048):
        near = units[i : i + 2048] @ pivots.T
        out[i : i + 2048] = np.argsort(-near, axis=1, kind="stable")[:, :length]
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def directions(q: np.ndarray) -> np.ndarray:
    """Queries as pivots see them: of unit length, level in the coordinate that was added."""
    return np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner product of each row with ``q``, the same for equal rows wherever they lie."""
    return np.einsum("ij,j->i", x, q)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, largest first, ties to the smaller id."""
    at = np.arange(len(score))
    if len(score) > k:  # ties at the edge stay until ids decide
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


@dataclass
class Space:
    """What is known of the vectors of one dimension; its size is bounded by the pivots."""

    longest: float
    pivots: np.ndarray
    centres: np.ndarray
    visits: int = 1

    @property
    def regions(self) -> int:
        return len(self.centres)


class InvertedFiles:
    """The pivot inverted files of one block."""

    def __init__(self, perms: np.ndarray, n_pivots: int):
        n, self.length = perms.shape
        pivot = perms.ravel().astype(np.int64)
        order = np.argsort(pivot, kind="stable")
        self.rows, self.places = order // self.length, order % self.length
        self.starts = np.searchsorted(pivot[order], np.arange(n_pivots + 1))
        self.n = n

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of every row of the block to ``perm``, up to a constant."""
        lists = [slice(self.starts[p], self.starts[p + 1]) for p in perm.tolist()]
        rows = np.concatenate([self.rows[s] for s in lists])
        gain = np.concatenate([self.length - np.maximum(self.places[s], j) for j, s in enumerate(lists)])
        return -2.0 * np.bincount(rows, weights=gain, minlength=self.n)


class Shard:
    """A shard's vectors with their inverted files; ``share`` of them, and no fewer than ``at_least``, are reranked."""

    def __init__(self, data: pa.Table, n_pivots: int, share: float, at_least: int):
        self.x, self.ids = matrix(data["vec"]), data["vec_id"].to_numpy()
        self.files = InvertedFiles(_perms(data["perm"]), n_pivots)
        self.take = min(len(self.x), max(at_least, int(share * len(self.x))))

    def nearest(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        found: list[tuple[np.ndarray, ...]] = []
        for q_id, q, perm in zip(queries["vec_id"].to_pylist(), matrix(queries["vec"]), _perms(queries["perm"]), strict=True):
            far = self.files.footrule(perm)
            cand = np.flatnonzero(far <= np.partition(far, self.take - 1)[self.take - 1])
            cand = cand[self.ids[cand] != q_id]
            score = products(self.x[cand], q)
            at = best(score, self.ids[cand], k)
            found.append((np.full(len(at), q_id), self.ids[cand[at]], score[at]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def _perms(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(len(column), -1)


def by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of (id, vector) taken apart by the vectors' dimension."""
    for b in batches:
        size = pc.list_value_length(b.column(1))
        for d in pc.unique(size).to_pylist():
            yield d, b.filter(pc.equal(size, d))


def spaces(every: DataFrame, *, pivots: int, sample: int, block: int, is_query: str, most_regions: int = 1 << 14) -> dict[int, Space]:
    """The dimensions that have queries, each with pivots and region pivots from a sample of its rows, drawn by a hash of the id.

    The sample is ``sample`` rows, or two for each region of the largest dimension.
    """
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    seen = every.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(squares).alias("top"), F.count_if(F.expr(is_query)).alias("queries")).filter("queries > 0").collect()
    wanted = {r.dim: min(most_regions, max(1, -(-r.n // block))) for r in seen}
    drawn = F.row_number().over(Window.partitionBy(F.size("vec")).orderBy(F.xxhash64("vec_id"), "vec_id"))
    rows: dict[int, list] = {}
    for r in every.withColumn("drawn", drawn).filter(F.col("drawn") <= max([sample, *(2 * n for n in wanted.values())])).orderBy("drawn").collect():
        rows.setdefault(len(r.vec), []).append(r.vec)
    out = {}
    for r in seen:
        longest = float(np.sqrt(r.top)) * (1 + 1e-12)
        own = choose_pivots(lift(np.array(rows[r.dim], dtype=np.float64), longest), max(pivots, wanted[r.dim]))
        out[r.dim] = Space(longest, own[:pivots], own[: wanted[r.dim]], min(wanted[r.dim], len(own)))
    return out


def calibrate(every: DataFrame, known: dict[int, Space], *, is_query: str, k: int, within: float, tried: int) -> None:
    """Sets how many regions a query visits, by the true neighbours of at most ``tried`` queries a dimension."""
    held = every.sparkSession.sparkContext.broadcast(known)
    asked: dict[int, list] = {}
    drawn = F.row_number().over(Window.partitionBy(F.size("vec")).orderBy(F.xxhash64("vec_id", F.lit("tried")), "vec_id"))
    for r in every.filter(is_query).withColumn("drawn", drawn).filter(F.col("drawn") <= tried).collect():
        asked.setdefault(len(r.vec), []).append((r.vec_id, r.vec))
    sent = every.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)) for d, rows in asked.items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in by_dimension(batches):
            if d not in sent.value:
                continue
            (q_ids, q), space, ids, x = sent.value[d], held.value[d], b.column(0).to_numpy(), matrix(b.column(1))
            region = permutations(lift(x, space.longest), space.centres, 1)[:, 0]
            visit = permutations(directions(q), space.centres, space.regions).argsort(axis=1)  # region -> when it is visited
            for i, near in enumerate(q @ x.T):
                near[ids == q_ids[i]] = -np.inf
                at = best(near, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array([int(q_ids[i])] * len(at)), pa.array(ids[at]), pa.array(near[at]), pa.array(visit[i, region[at]].astype(np.int32))], ["dim", "query_id", "vec_id", "score", "visit"])

    found = every.mapInArrow(scan, "dim int, query_id long, vec_id long, score double, visit int").filter("score > double('-inf')")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    for r in true.groupBy("dim").agg(F.percentile("visit", F.lit(within)).alias("v")).collect():
        known[r.dim].visits = min(known[r.dim].regions, int(np.ceil(r.v)) + 1)


def search(
    rows: DataFrame,
    *,
    is_query: str = "vec_id % 20 = 0",
    k: int = 20,
    pivots: int = 512,
    length: int = 64,
    sample: int = 2048,
    share: float = 0.15,
    at_least: int = 200,
    within: float = 0.98,
    tried: int = 256,
    block: int = 8192,
    most_regions: int = 1 << 14,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row.

    ``pivots`` and the pivots of regions come from a sample (see ``spaces``), the only part
    fitted on one. ``share`` of a shard's rows, and no fewer than ``at_least``, are reranked
    for each query.
    """
    spark = rows.sparkSession
    every = usable(rows, vec_id, vector)
    known = spaces(every, pivots=pivots, sample=sample, block=block, most_regions=most_regions, is_query=is_query)
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    calibrate(every, known, is_query=is_query, k=k, within=within, tried=tried)
    held = spark.sparkContext.broadcast(known)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in by_dimension(batches):
            if space := held.value.get(d):
                units = lift(matrix(b.column(1)), space.longest)
                perm = permutations(units, space.pivots, min(length, len(space.pivots)))
                region = permutations(units, space.centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(perm), d, np.int32)), pa.array(region.astype(np.int32)), pa.array([p.tobytes() for p in perm], pa.binary())], ["vec_id", "vec", "dim", "region", "perm"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in by_dimension(batches):
            space = held.value[d]
            units = directions(matrix(b.column(1)))
            perm = permutations(units, space.pivots, min(length, len(space.pivots)))
            visit = permutations(units, space.centres, space.visits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(perm), d, np.int32)), pa.array(visit.tolist(), pa.list_(pa.int32())), pa.array([p.tobytes() for p in perm], pa.binary())], ["vec_id", "vec", "dim", "visit", "perm"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(4)], axis=1)  # dim, region, shard, kind
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                *key, kind = keys[lo].tolist()
                if key != at:
                    at, parts, shard = key, [], None
                rows_ = b.slice(lo, hi - lo)
                if kind == 0:
                    parts.append(rows_)
                elif parts or shard:
                    shard, parts = shard or Shard(pa.Table.from_batches(parts), len(held.value[key[0]].pivots), share, at_least), []
                    yield shard.nearest(rows_, k)

    # shards of each region, and queries to all shards of the regions that they visit
    posted = materialize(every.mapInArrow(post, "vec_id long, vec array<double>, dim int, region int, perm binary"), "postings")
    sizes = materialize(posted.groupBy("dim", "region").agg(F.ceil(F.count("*") / block).cast("int").alias("shards")), "regions")  # at most the regions of each dimension
    index = posted.join(F.broadcast(sizes), ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), "shards").cast("int"))
    asked = every.filter(is_query).mapInArrow(ask, "vec_id long, vec array<double>, dim int, visit array<int>, perm binary").withColumn("region", F.explode("visit"))
    asked = asked.join(F.broadcast(sizes), ["dim", "region"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    cols = ["dim", "region", "shard", "kind", "vec_id", "vec", "perm"]
    both = index.withColumn("kind", F.lit(0)).select(cols).unionByName(asked.withColumn("kind", F.lit(1)).select(cols))
    found = both.repartition("dim", "region", "shard").sortWithinPartitions("dim", "region", "shard", "kind").mapInArrow(scan, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, rows: DataFrame, *, is_query: str = "vec_id % 20 = 0", k: int = 20, tried: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> float:
    """The share of true neighbours, by scores, that ``found`` holds for ``tried`` queries drawn by a hash of their ids."""
    every = usable(rows, vec_id, vector)
    q = every.filter(is_query).orderBy(F.xxhash64("vec_id", F.lit("recall")), "vec_id").limit(tried).selectExpr("vec_id as query_id", "vec as q")
    pairs = every.join(F.broadcast(q), (F.col("vec_id") != F.col("query_id")) & (F.size("vec") == F.size("q")))
    score = F.aggregate(F.zip_with("vec", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    last = pairs.select("query_id", score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    held = found.join(F.broadcast(last), "query_id").groupBy("query_id").agg(F.count_if(F.col("score") >= F.col("least") - 1e-9).alias("hit"))
    return last.join(held, "query_id", "left").agg(F.sum(F.least(F.coalesce("hit", F.lit(0)), "n")) / F.sum("n")).first()[0]
