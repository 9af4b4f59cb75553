"""Dense kernels over slabs of slices, for any number of volumes at once.

Rows of voxels (volume_id, k, j, i and fields) become rows of slices, a volume's
slices meet in slabs of ``depth``, each with the slices around it that the kernel reads
(its halo), and the kernel sees a slab as dense arrays. Sizes and spacing come from the
grid table (volume_id, nx, ny, nz, sx, sy, sz), so that volumes of different size share
a call; a task holds one slab, whatever the size of its volume. Only slices travel, each
once for the slab it lies in and once for every slab whose halo it is in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 16


def one_grid(spark: SparkSession, nx: int, ny: int, nz: int, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), volume_id: str = "") -> DataFrame:
    """The grid table of a single volume."""
    size = zip(("nx", "ny", "nz", "sx", "sy", "sz"), (nx, ny, nz, *map(float, spacing)), strict=True)
    return spark.range(1).select(F.lit(volume_id).alias("volume_id"), *(F.lit(v).alias(n) for n, v in size))


def grid_of(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The grid table of whole volumes: sizes as seen, one spacing for all."""
    sizes = voxels.groupBy("volume_id").agg(*((F.max(c) + 1).alias(n) for c, n in (("i", "nx"), ("j", "ny"), ("k", "nz"))))
    return sizes.select("volume_id", "nx", "ny", "nz", *(F.lit(float(s)).alias(n) for s, n in zip(spacing, ("sx", "sy", "sz"), strict=True)))


def per_volume(rows: DataFrame, volumes: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``volumes`` (one row a volume), which go to the rows: a join by key would read a volume in one task."""
    return rows.join(F.broadcast(volumes), "volume_id")


class Slab:
    """One slab: slices ``lo`` to ``hi`` are its own, ``base`` to ``top`` those at hand."""

    def __init__(self, t: pa.Table, depth: int):
        first = t.slice(0, 1).to_pylist()[0]
        self.volume_id, self.halo = first["volume_id"], first["halo"]
        self.nx, self.ny, self.nz = (int(first[c]) for c in ("nx", "ny", "nz"))
        self.spacing = tuple(float(first[c]) for c in ("sx", "sy", "sz"))
        self.lo = int(first["slab"]) * depth
        self.hi = min(self.nz, self.lo + depth)
        self.base, self.top = max(0, self.lo - self.halo), min(self.nz, self.hi + self.halo)
        plane = t["plane"].combine_chunks()
        of = np.repeat(t["k"].to_numpy(), np.diff(plane.offsets.to_numpy()))
        held = plane.flatten()
        self.at = (of - self.base, held.field("j").to_numpy(), held.field("i").to_numpy())
        self.held = held

    def dense(self, name: str, kind: type = np.float64, fill: float = 0) -> np.ndarray:
        """A field over all slices at hand; ``fill`` where no voxel is."""
        a = np.full((self.top - self.base, self.ny, self.nx), fill, dtype=kind)
        a[self.at] = self.held.field(name).to_numpy(zero_copy_only=False)
        return a

    def present(self) -> np.ndarray:
        a = np.zeros((self.top - self.base, self.ny, self.nx), dtype=bool)
        a[self.at] = True
        return a

    def own(self, a: np.ndarray) -> np.ndarray:
        return a[self.lo - self.base : self.hi - self.base]

    def table(self, where: np.ndarray, **columns: np.ndarray) -> pa.Table:
        """volume_id, idx, k, j, i and ``columns`` of the own voxels that ``where`` holds."""
        k, j, i = np.nonzero(where)
        cols = {"volume_id": pa.array([self.volume_id] * len(k), pa.string()), "idx": ((k + self.lo) * self.ny + j) * self.nx + i}
        cols |= {n: x.astype(np.int32) for n, x in zip("kji", (k + self.lo, j, i), strict=True)}
        return pa.table(cols | {n: x[where] for n, x in columns.items()})


#: The columns that ``Slab.table`` gives before its own.
PLACE = "volume_id string, idx long, k int, j int, i int"


def over_slabs(voxels: DataFrame, grid: DataFrame, kernel: Callable[[Slab], pa.Table], out: str, *, fields: list[str], halo: Column | int = 0, depth: int = DEPTH) -> DataFrame:
    """What ``kernel`` makes of every slab of every volume that has voxels.

    ``halo`` may be a column of the grid table. A slice is one row on its way; it is
    bounded by the size of an image.
    """
    return over(spread(voxels, grid, fields, halo, depth), kernel, out, depth)


def spread(voxels: DataFrame, grid: DataFrame, fields: list[str], halo: Column | int = 0, depth: int = DEPTH) -> DataFrame:
    """A row for every slice and slab (volume_id, slab) that it lies in or is in the halo of."""
    reach = F.lit(halo) if isinstance(halo, int) else halo
    planes = voxels.groupBy("volume_id", "k").agg(F.collect_list(F.struct("j", "i", *fields)).alias("plane"))
    sized = per_volume(planes, grid.withColumn("halo", reach.cast("int")))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("k") - F.col("halo")) / depth))
    last = F.least(F.floor((F.col("nz") - 1) / depth), F.floor((F.col("k") + F.col("halo")) / depth))
    return sized.withColumn("slab", F.explode(F.sequence(first, last)))


def over(rows: DataFrame, kernel: Callable[[Slab], pa.Table], out: str, depth: int = DEPTH) -> DataFrame:
    """``over_slabs`` of rows that are spread already, such as a table that ``layout`` wrote."""
    return rows.groupBy("volume_id", "slab").applyInArrow(lambda t: kernel(Slab(t, depth)), out)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _none(out: str) -> pa.Table:
    return pa.table({n: pa.array([], _KINDS.get(k) or pa.list_(_KINDS[k[6:-1]])) for n, k in (c.split()[:2] for c in out.split(", "))})


def read_slabs(readers: DataFrame, voxels: DataFrame, grid: DataFrame, kernel: Callable[[Slab, pa.Table], pa.Table], out: str, *, fields: list[str], halo: int = 0, depth: int = DEPTH) -> DataFrame:
    """What ``kernel`` makes of every slab and the ``readers`` (volume_id, slab and more) that are sent to it."""
    return read(readers, spread(voxels, grid, fields, halo, depth), kernel, out, depth)


def read(readers: DataFrame, rows: DataFrame, kernel: Callable[[Slab, pa.Table], pa.Table], out: str, depth: int = DEPTH) -> DataFrame:
    """``read_slabs`` of rows that are spread already."""
    readers = readers.select(*(F.col(c).alias(c) for c in readers.columns))  # they may come from the same grid table
    run = lambda planes, asked: kernel(Slab(planes, depth), asked) if planes.num_rows and asked.num_rows else _none(out)
    return rows.groupBy("volume_id", "slab").cogroup(readers.groupBy("volume_id", "slab")).applyInArrow(run, out)


def side_by_side(one: DataFrame, other: DataFrame, kernel: Callable[[Slab, Slab | None], pa.Table], out: str, depth: int = DEPTH) -> DataFrame:
    """What ``kernel`` makes of the same slab of two spread tables (None where the other one has none); slabs of the other one alone are left out."""
    run = lambda a, b: kernel(Slab(a, depth), Slab(b, depth) if b.num_rows else None) if a.num_rows else _none(out)
    return one.groupBy("volume_id", "slab").cogroup(other.groupBy("volume_id", "slab")).applyInArrow(run, out)


# --- kernels ---


def shifts(shape: tuple[int, ...], offset: tuple[int, int, int]) -> tuple[tuple[slice, ...], tuple[slice, ...]]:
    """Where a voxel and its neighbour at ``offset`` (di, dj, dk) both lie inside."""
    d = offset[::-1]
    here = tuple(slice(max(0, -x), n - max(0, x)) for x, n in zip(d, shape, strict=True))
    there = tuple(slice(max(0, x), n - max(0, -x)) for x, n in zip(d, shape, strict=True))
    return here, there


def joined(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over edges (a, b): the smallest node that each of ``size`` nodes reaches."""
    root = np.arange(size)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def labels(member: np.ndarray, offsets: list[tuple[int, int, int]], same: np.ndarray | None = None) -> np.ndarray:
    """For each voxel the smallest flat place that it reaches over members next to each other, equal in ``same``."""
    place, left, right = np.arange(member.size).reshape(member.shape), [], []
    for o in offsets:
        here, there = shifts(member.shape, o)
        ok = member[here] & member[there]
        if same is not None:
            ok &= same[here] == same[there]
        left.append(place[here][ok])
        right.append(place[there][ok])
    return joined(member.size, np.concatenate(left), np.concatenate(right)).reshape(member.shape)


def pinched(mask: np.ndarray) -> np.ndarray:
    """Voxels with members of ``mask`` on both sides of an axis."""
    out = np.zeros_like(mask)
    for axis in range(3):
        inner = [slice(None)] * 3
        before, after = list(inner), list(inner)
        inner[axis], before[axis], after[axis] = slice(1, -1), slice(None, -2), slice(2, None)
        out[tuple(inner)] |= mask[tuple(before)] & mask[tuple(after)]
    return out


def first_met(dark: np.ndarray, value: np.ndarray, offset: tuple[int, int, int], limit: int) -> np.ndarray:
    """``value`` of the first voxel that is not dark from each voxel in the direction of ``offset``, within ``limit`` steps; -1 if none."""
    met, left = np.full(dark.shape, -1, dtype=np.int8), np.ones(dark.shape, dtype=bool)
    for t in range(1, limit + 1):
        if t >= dark.shape[next(a for a, x in enumerate(offset[::-1]) if x)]:
            break
        here, there = shifts(dark.shape, tuple(t * x for x in offset))
        hit = left[here] & ~dark[there] & (value[there] >= 0)
        met[here][hit] = value[there][hit]
        left[here][hit] = False
        if not left.any():
            break
    return met
