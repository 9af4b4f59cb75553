"""Pairs of sets with Jaccard >= t, none lost: a prefix-filtered join on hashes.

All sets are read in one global order. Of a pair that reaches ``t`` the larger set
shows one of the common elements among its first n - ceil(t n) + 1 (its prefix), and
the smaller one the same element among its first n - ceil(2t/(1+t) n) + 1, about half
as many (its index prefix); from the first such element on both hold enough of the
rest. The order is free to choose without losing a pair: what a sample shows to be
common goes last, so that buckets stay small.

Rows (key, node, class, n, at) are sorted by key, then size, over ranges of rows: a
key held by many may stretch over tasks and never has to fit into one. A bucket's
members are numbered in that order, so that each can only be the larger set to those
before it and lengths end its reach. Buckets are worked off in rounds. A round pairs
the first members of a bucket (its hubs) with those after them, leaves out pairs that
verified classes imply already, and lets a hub go only then; the last round pairs all
that are left. Large buckets are dealt out as tiles of ``TILE`` by ``TILE`` members,
those tiles only whose lengths can meet.

What is proposed is looked at once more: a set has a parity bitmap, about four bits for each element, in which an element flips one bit.
Two bitmaps differ in no more bits than their sets differ in elements, and sets that
reach ``t`` differ in at most (1-t)/(1+t) of their summed sizes. Only what is left of the
buckets carries bitmaps, so that a group of texts that are not close makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelake.llm.common import materialize

TILE = 1024
#: At most so many common elements are put last.
COMMON = 1 << 16
EDGES = "a long, b long"
ROWS = "key long, node long, class long, n int, at int"
NAMES = ["key", "node", "class", "n", "at", "rank", "m", "part"]
#: In ``part``: a pair (node, class), a member of a bucket that lies within one task; from 0 on, a piece of one that may not.
PAIR, INNER = -2, -1


def bitmap(h: np.ndarray) -> bytes:
    """The parity bitmap of a set of distinct hashes: a power of two of bits, about four for each, 64 at least."""
    size = 64
    while size < 4 * len(h):
        size *= 2
    odd = np.bincount((h >> np.uint64(32)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the larger one is folded to the size of the other."""
    x, y = (np.frombuffer(v, dtype=np.uint64) for v in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


class Order:
    """The global order: elements not known as common by hash, then the common ones, rarest first."""

    def __init__(self, common: np.ndarray | list[tuple[int, int]]):
        """``common`` has rows (element as signed long, count)."""
        rows = np.array(common, dtype=np.int64).reshape(-1, 2)
        h = rows[:, 0].copy().view(np.uint64)
        at = np.argsort(h)
        self.elements, self.counts = h[at], rows[at, 1]

    def prefix(self, h: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
        """The elements of the set of distinct, sorted hashes by which it is found (as signed longs), and its size."""
        n = len(h)
        if len(self.elements) and n:
            at = np.minimum(np.searchsorted(self.elements, h), len(self.elements) - 1)
            h = h[np.lexsort((h, np.where(self.elements[at] == h, self.counts[at], 0)))]
        return h[: n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0].view(np.int64), n


def near_enough(a: list[bytes], b: list[bytes], both: np.ndarray, t: float) -> np.ndarray:
    """Whether bitmaps leave it open that pairs of sets, of ``both`` elements together, reach ``t``."""
    d = np.fromiter(map(apart, a, b), np.int64, len(a))
    return (1 + t) * d <= (1 - t) * both + 1e-6


def may_reach(c: list[np.ndarray], i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Whether members i and j (i before j) of a bucket are of two classes and may reach ``t``, by lengths and places."""
    _, node, kind, n, at = c[:5]
    small, large = n[i].astype(np.int64), n[j].astype(np.int64)
    rest = np.minimum(small - at[i], large - at[j])
    indexed = at[i] <= small - np.ceil(2 * t / (1 + t) * small - 1e-9)
    return indexed & (small >= t * large - 1e-6) & ((1 + t) * rest >= t * (small + large) - 1e-6) & (kind[i] != kind[j]) & (node[i] != node[j])


def _batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [np.int64] * 3 + [np.int32] * 5
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k, copy=False)) for x, k in zip(cols, kinds, strict=True)], NAMES)


def _bounds(cols: list[np.ndarray], keys: int) -> tuple[np.ndarray, np.ndarray]:
    change = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
    starts = np.flatnonzero(np.r_[True, change])
    return starts, np.diff(np.r_[starts, len(cols[0])])


def buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """Of ``rows`` (``ROWS``) what may make a pair, written: ``rank`` and size ``m`` in the bucket, and ``part``.

    Buckets of two become pairs at once, and so do the first members of larger ones with
    all others; a bucket of one class is left out. The first and the last key of a task's
    range may go on in another: their rows are handed on, and numbered across tasks.
    """

    def inner(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts, sizes = _bounds(c, 1)
        rank = np.arange(len(c[0])) - np.repeat(starts, sizes)
        hub, j = np.repeat(starts, sizes)[rank > 0], np.flatnonzero(rank)
        ok = may_reach(c, hub, j, threshold)
        a, b = c[1][hub[ok]], c[1][j[ok]]
        nothing = np.zeros(len(a), np.int32)
        yield _batch([nothing, np.minimum(a, b), np.maximum(a, b), *[nothing] * 4, nothing + PAIR])
        keep = np.repeat((np.minimum.reduceat(c[2], starts) != np.maximum.reduceat(c[2], starts)) & (sizes > 2), sizes)
        yield _batch([*(x[keep] for x in (*c, rank, np.repeat(sizes, sizes))), np.full(keep.sum(), INNER)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, seen, held = TaskContext.get().partitionId(), None, 0, []

        def piece(c: list[np.ndarray], at: int) -> pa.RecordBatch:
            return _batch([*c, np.arange(at, at + len(c[0])), np.zeros(len(c[0])), np.full(len(c[0]), part)])

        for b in batches:
            if not b.num_rows:
                continue
            c = [x.to_numpy() for x in b.columns]
            first = c[0][0] if first is None else first
            cut = int(np.searchsorted(c[0], first, side="right"))
            if cut:  # the first key's rows go on as they come
                yield piece([x[:cut] for x in c], seen)
                seen += cut
                c = [x[cut:] for x in c]
            if not len(c[0]):
                continue
            last = int(np.searchsorted(c[0], c[0][-1], side="left"))
            if held and held[-1][0][-1] != c[0][0] or last:  # what is held has ended, but for the batch's last key
                done = [np.concatenate(x) for x in zip(*held, [x[:last] for x in c], strict=True)]
                held, c = [], [x[last:] for x in c]
                yield from inner(done)
            held.append(c)
        if held:
            yield piece([np.concatenate(x) for x in zip(*held, strict=True)], 0)

    dealt = rows.repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node")
    out = materialize(dealt.mapInArrow(run, ROWS + ", rank int, m int, part int"), "buckets")
    # pieces: at most two for each task, numbered on from each other in the tasks' order
    pieces = out.filter("part >= 0").groupBy("key", "part").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high"))
    whole, before = Window.partitionBy("key"), Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of = pieces.select("key", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(whole).alias("of"), (F.min("low").over(whole) != F.max("high").over(whole)).alias("mixed"))
    numbered = out.filter("part >= 0").join(F.broadcast(of.filter("of > 1 and mixed")), ["key", "part"])
    numbered = numbered.select("key", "node", "class", "n", "at", (F.col("rank") + F.col("base")).cast("int").alias("rank"), F.col("of").cast("int").alias("m"), "part")
    return out.filter("part < 0").unionByName(numbered)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of runs of rows that end where a group does; rows are sorted by their first ``keys`` columns."""
    held: list[list[np.ndarray]] = []  # batches of the group that has not ended

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held and any(c[0] != h[-1] for c, h in zip(new[:keys], held[-1], strict=False)):
            yield joined()
            held = []
        last = np.flatnonzero(np.any([c != c[-1] for c in new[:keys]], axis=0))
        if len(last):  # all groups of the batch but the last are complete
            at = last[-1] + 1
            held.append([c[:at] for c in new])
            yield joined()
            held, new = [], [c[at:] for c in new]
        held.append(new)
    if held:
        yield joined()


def pairs(rows: DataFrame, threshold: float, first: int, most: int | None) -> DataFrame:
    """Distinct pairs (a, b) of different classes that may reach ``threshold``.

    Of each bucket of ``rows`` (key, node, class, n, at, rank, m, bits) the members of rank
    ``first`` on, ``most`` of them or all, are paired with those after them.
    """
    end = (1 << 31) - 1 if most is None else first + most

    def of(c: list[np.ndarray]) -> pa.RecordBatch:
        starts, sizes = _bounds(c, 3)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own, rank, bits = [c[0], *c[3:7]], c[7], c[8]
        for s, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            if own[2][s : s + size].min() == own[2][s : s + size].max():
                continue
            at = np.arange(s, s + size)
            hubs, others = at[(rank[at] < end) & (rank[at] // TILE == c[1][s])], at[rank[at] // TILE == c[2][s]]
            for x in range(0, len(hubs), 256):
                i, j = np.nonzero(rank[hubs[x : x + 256], None] < rank[others][None, :])
                i, j = hubs[x + i], others[j]
                ok = may_reach(own, i, j, threshold)
                i, j = i[ok], j[ok]
                ok = near_enough(bits[i].tolist(), bits[j].tolist(), own[3][i].astype(np.int64) + own[3][j], threshold)
                left.append(i[ok])
                right.append(j[ok])
        i, j = np.concatenate(left), np.concatenate(right)
        e = np.unique(np.sort(np.stack([own[1][i], own[1][j]], axis=1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(of, whole_groups(batches, 3))

    left = rows.filter(F.col("rank") >= first).withColumn("run", F.floor(F.col("rank") / TILE).cast("int"))
    small = left.filter(F.col("m") <= TILE).withColumns({"p": F.lit(0), "q": F.lit(0)})
    large = left.filter(F.col("m") > TILE)
    runs = large.groupBy("key", "run").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meet = (F.col("x.run") <= F.col("y.run")) & (F.col("x.high") >= threshold * F.col("y.low") - 1e-6) & (F.col("x.run") * TILE < end)
    tiles = runs.alias("x").join(runs.alias("y"), (F.col("x.key") == F.col("y.key")) & meet).select("x.key", F.col("x.run").alias("p"), F.col("y.run").alias("q"))
    places = tiles.select("key", "p", "q", F.col("p").alias("run")).union(tiles.filter("p <> q").select("key", "p", "q", "q"))
    dealt = small.unionByName(large.join(places, ["key", "run"])).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "rank")
    return dealt.select("key", "p", "q", "node", "class", "n", "at", "rank", "bits").mapInArrow(run, EDGES).distinct()


def alike(some: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps, in ``bits`` (node, n, bits), leave it open whether they reach ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(near_enough(b.column(4).to_pylist(), b.column(5).to_pylist(), sizes, threshold), pa.bool_()))

    left, right = (bits.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("bits" + c)) for c in "ab")
    return some.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, EDGES)
