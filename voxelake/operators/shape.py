"""Multi-scale shape of dark structures: Gaussian smoothing, Hessians, eigenvalues.

All of it is one kernel over slabs of slices (see ``slabs``), for volumes of any number
and size: a slab with a halo as deep as the widest scale asks for is averaged in blocks,
smoothed along each axis, differenced and taken apart into eigenvalues, scale by scale,
and leaves the task as one row a voxel. Eigenvalues and shape rules exist as columns too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.operators import slabs
from voxelake.operators.slabs import PLACE, Slab

SCALES = (0.7, 1.4, 2.8)  # mm
STRUCTURE_SCALE, MAX_RADIUS, SAMPLES_PER_SIGMA = 0.05, 24, 2


def kernel(sigma_voxels: float) -> list[float]:
    radius = min(MAX_RADIUS, max(1, math.ceil(3 * sigma_voxels)))
    w = [math.exp(-(t * t) / (2 * sigma_voxels * sigma_voxels)) for t in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def block_for(spacing: tuple[float, float, float], sigma: float) -> tuple[int, ...]:
    return tuple(max(1, int(sigma // (SAMPLES_PER_SIGMA * s))) for s in spacing)


def _blur(a: np.ndarray, axis: int, w: np.ndarray) -> np.ndarray:
    r = len(w) // 2
    pad = [(r, r) if x == axis else (0, 0) for x in range(3)]
    b = np.pad(a, pad, mode="edge").astype(np.float64)
    n = a.shape[axis]
    return sum(wt * np.take(b, range(t, t + n), axis=axis) for t, wt in enumerate(w)).astype(np.float32)


def radius(sigma: float, spacing: float) -> int:
    """Voxels by which smoothing reaches out; none where the scale is under a twentieth of a voxel."""
    return len(kernel(sigma / spacing)) // 2 if sigma / spacing >= 0.05 else 0


def blurred(a: np.ndarray, sigma: float, spacing: tuple[float, float, float]) -> np.ndarray:
    for axis, size in zip((2, 1, 0), spacing, strict=True):
        if radius(sigma, size):
            a = _blur(a, axis, np.array(kernel(sigma / size)))
    return a


def _reach(column: str, sigma: float) -> Column:
    """``radius`` of a grid table's spacing."""
    own = F.greatest(F.lit(1), F.least(F.lit(MAX_RADIUS), F.ceil(3 * sigma / F.col(column))))
    return F.when(sigma / F.col(column) >= 0.05, own).otherwise(0)


def smooth(field: DataFrame, sigma: float, grid: DataFrame, depth: int = slabs.DEPTH) -> DataFrame:
    """volume_id, idx, k, j, i, value of a field (volume_id, k, j, i, value) smoothed by ``sigma`` mm, edges clamped."""

    def run(s: Slab) -> pa.Table:
        a = s.own(blurred(s.dense("value", np.float32), sigma, s.spacing))
        return s.table(np.ones(a.shape, dtype=bool), value=a)

    return slabs.over_slabs(field, grid, run, PLACE + ", value float", fields=["value"], halo=_reach("sz", sigma), depth=depth)


SECOND = ("xx", "yy", "zz", "xy", "xz", "yz")


def differences(a: np.ndarray, spacing: tuple[float, float, float]) -> dict[str, np.ndarray]:
    """Second differences of the inner voxels (one less on every side) of a slab."""
    at = lambda i=0, j=0, k=0: a[1 + k : a.shape[0] - 1 + k, 1 + j : a.shape[1] - 1 + j, 1 + i : a.shape[2] - 1 + i]
    unit = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
    out = {n: (at(*d) - 2 * at() + at(*(-x for x in d))) / (s * s) for n, d, s in zip(SECOND, unit, spacing, strict=False)}
    for n, (p, q) in zip(SECOND[3:], ((0, 1), (0, 2), (1, 2)), strict=True):
        both, cross = ([x + f * y for x, y in zip(unit[p], unit[q], strict=True)] for f in (1, -1))
        out[n] = (at(*both) - at(*cross) - at(*(-x for x in cross)) + at(*(-x for x in both))) / (4 * spacing[p] * spacing[q])
    return out


def hessian(field: DataFrame, grid: DataFrame) -> DataFrame:
    """volume_id, idx and xx, yy, zz, xy, xz, yz of inner voxels (a border voxel has none)."""
    return hessian_of(slabs.spread(field, grid, ["value"], 1))


def hessian_of(rows: DataFrame) -> DataFrame:
    """``hessian`` of spread rows with a halo of at least one slice."""

    def run(s: Slab) -> pa.Table:
        inner, found = _inner(s.dense("value"), s.spacing, s.base, s.lo, s.hi)
        return s.table(inner, **found).drop_columns(["k", "j", "i"])

    return slabs.over(rows, run, "volume_id string, idx long, " + ", ".join(f"{n} double" for n in SECOND))


def _inner(a: np.ndarray, spacing: tuple[float, float, float], base: int, lo: int, hi: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which voxels of slices ``lo`` to ``hi`` have all neighbours in ``a`` (from slice ``base`` on), and the differences there (zero elsewhere)."""
    inner = np.zeros((hi - lo, *a.shape[1:]), dtype=bool)
    found = {n: np.zeros(inner.shape) for n in SECOND}
    first, last = max(lo, base + 1), min(hi, base + len(a) - 1)
    if first < last and min(a.shape[1:]) > 2:
        where = (slice(first - lo, last - lo), slice(1, -1), slice(1, -1))
        inner[where] = True
        for n, d in differences(a[first - 1 - base : last + 1 - base], spacing).items():
            found[n][where] = d
    return inner, found


def eigen(xx: np.ndarray, yy: np.ndarray, zz: np.ndarray, xy: np.ndarray, xz: np.ndarray, yz: np.ndarray) -> np.ndarray:
    """The three eigenvalues of symmetric matrices, smallest magnitude first, in the last axis."""
    m = np.stack([np.stack(row, axis=-1) for row in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], axis=-1)
    e = np.linalg.eigvalsh(m)
    return np.take_along_axis(e, np.argsort(np.abs(e), axis=-1, kind="stable"), axis=-1)


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """The three eigenvalues of a symmetric matrix, smallest magnitude first (closed form)."""
    off = xy * xy + xz * xz + yz * yz
    mean = (xx + yy + zz) / 3
    a, b, c = xx - mean, yy - mean, zz - mean
    radius = F.sqrt((a * a + b * b + c * c + 2 * off) / 6)
    r = F.when(radius == 0, 1.0).otherwise(radius)
    det = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (r * r * r)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / 2))) / 3
    first = mean + 2 * radius * F.cos(angle)
    third = mean + 2 * radius * F.cos(angle + 2 * math.pi / 3)
    three = F.when(off < 1e-24, F.array(xx, yy, zz)).otherwise(F.array(first, 3 * mean - first - third, third))
    sized = F.transform(three, lambda x, n: F.struct(F.abs(x).alias("size"), n.alias("n"), x.alias("x")))
    return F.transform(F.array_sort(sized), lambda s: s["x"])


def shape(small: Column, middle: Column, large: Column) -> tuple[Column, Column]:
    """Kind (tube, sheet, blob or none) and confidence from eigenvalues by magnitude."""
    mid = F.greatest(middle, F.lit(0.0)) / large
    low = F.abs(small) / large
    tube, sheet, blob = mid * (1 - low), 1 - mid, low
    top = F.greatest(tube, sheet, blob)
    second = tube + sheet + blob - top - F.least(tube, sheet, blob)
    strength = 1 - F.exp(-(large * large) / (2 * STRUCTURE_SCALE * STRUCTURE_SCALE))
    saddle = F.greatest(F.lit(0.0), -middle) / large
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (top - second) * strength * (1 - saddle)))
    none = (large <= 0) | (sure <= 0)
    kind = F.when(none, "none").when(tube == top, "tube").when(sheet == top, "sheet").otherwise("blob")
    return kind, F.when(none, 0.0).otherwise(sure)


def named(small: np.ndarray, middle: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in (none, tube, sheet, blob) and confidence, by the rule of ``shape``, for arrays."""
    safe = np.where(large > 0, large, 1.0)
    mid, low = np.maximum(middle, 0.0) / safe, np.abs(small) / safe
    scores = np.stack([mid * (1 - low), 1 - mid, low])
    ordered = np.sort(scores, axis=0)
    strength, saddle = 1 - np.exp(-(large * large) / (2 * STRUCTURE_SCALE * STRUCTURE_SCALE)), np.maximum(0.0, -middle) / safe
    sure = np.clip((ordered[2] - ordered[1]) * strength * (1 - saddle), 0.0, 1.0)
    sure[large <= 0] = 0.0
    return np.where(sure > 0, scores.argmax(axis=0) + 1, 0), sure


def _at_scale(s: Slab, value: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, gamma-normalised, of the slab's own voxels at one scale, and where there are any."""
    bx, by, bz = block_for(s.spacing, sigma)
    n = [max(1, d // b) for d, b in zip((s.nz, s.ny, s.nx), (bz, by, bx), strict=True)]
    wide = tuple(x * b for x, b in zip(s.spacing, (bx, by, bz), strict=True))
    out, known = np.zeros((s.hi - s.lo, s.ny, s.nx, 3)), np.zeros((s.hi - s.lo, s.ny, s.nx), dtype=bool)
    lo, hi = s.lo // bz, min(n[0], (s.hi - 1) // bz + 1)  # cells of the slab's own voxels
    if lo >= hi:
        return out, known
    far = radius(sigma, wide[2]) + 1
    base, top = max(0, lo - far), min(n[0], hi + far)
    size = [min(b, d) for b, d in zip((bz, by, bx), (s.nz, s.ny, s.nx), strict=True)]
    cells = value[base * bz - s.base : base * bz - s.base + (top - base) * size[0], : n[1] * size[1], : n[2] * size[2]]
    cells = cells.reshape(top - base, size[0], n[1], size[1], n[2], size[2]).mean(axis=(1, 3, 5)).astype(np.float32)
    inner, found = _inner(blurred(cells, sigma, wide).astype(np.float64), wide, base, lo, hi)
    e = np.zeros((*inner.shape, 3))
    e[inner] = eigen(*(found[x][inner] for x in SECOND)) * (sigma * sigma)
    k, j, i = (np.arange(a, b) // c for a, b, c in ((s.lo, s.hi, bz), (0, s.ny, by), (0, s.nx, bx)))
    k, j, i = ((x[x < m]) for x, m in zip((k, j, i), n, strict=True))
    own = np.ix_(k - lo, j, i)
    out[: len(k), : len(j), : len(i)], known[: len(k), : len(j), : len(i)] = e[own], inner[own]
    return out, known


def shapes(field: DataFrame, grid: DataFrame, scales: tuple[float, ...] = SCALES, least: float = 0.08) -> DataFrame:
    """volume_id, idx, kind, confidence, sigma of the scale with the largest eigenvalue; faint ones are none.

    ``field`` has volume_id, k, j, i, value for whole volumes.
    """

    def run(s: Slab) -> pa.Table:
        value = s.dense("value")
        best, sigma = np.zeros((s.hi - s.lo, s.ny, s.nx, 3)), np.zeros((s.hi - s.lo, s.ny, s.nx))
        for x in sorted(scales):  # of equal ones the smallest scale stays
            e, known = _at_scale(s, value, x)
            better = known & (e[..., 2] > best[..., 2])
            best[better], sigma[better] = e[better], x
        kind, sure = named(*np.moveaxis(best, -1, 0))
        faint = sure < least
        kind[faint], sure[faint] = 0, 0.0
        t = s.table(sigma > 0, kind=kind.astype(np.int8), confidence=sure, sigma=sigma)
        return t.drop_columns(["k", "j", "i"])

    def halo(sigma: float) -> Column:
        b = F.greatest(F.lit(1), F.floor(sigma / (SAMPLES_PER_SIGMA * F.col("sz"))))
        wide = b * F.col("sz")
        own = F.greatest(F.lit(1), F.least(F.lit(MAX_RADIUS), F.ceil(3 * sigma / wide)))
        return (F.when(sigma / wide >= 0.05, own).otherwise(0) + 2) * b

    deep = F.greatest(F.lit(0).cast("long"), *(halo(x) for x in scales))
    found = slabs.over_slabs(field, grid, run, "volume_id string, idx long, kind byte, confidence double, sigma double", fields=["value"], halo=deep)
    return found.withColumn("kind", F.get(F.array(*map(F.lit, ("none", "tube", "sheet", "blob"))), F.col("kind").cast("int")))
