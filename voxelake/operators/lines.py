"""Samples along straight lines through volumes: slabs of any plane, and the ray march.

A line has ``n`` points o + d (t0 + i dt) in the voxel space of its volume. Lines are
sent to the slabs of slices that they cross (see ``slabs``) and each slab's kernel reads
the points that lie nearest to its own slices, by eight neighbours, edges clamped. What
a line's slabs give is put together in one aggregation by line: a maximum, or samples
to be folded front to back. A line that runs along the whole stack is thus read by as
many tasks as it has slabs, and none holds the volume.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.functions import geometry as g
from voxelake.functions import views
from voxelake.operators import slabs
from voxelake.operators.slabs import Slab

LINE = ("ox", "oy", "oz", "dx", "dy", "dz", "t0", "dt", "n")
MOST_STEPS, OPAQUE, FAINT = 1024, 0.995, 0.0005  # fixed: points of a ray, where it stops, what it skips
BOUNDARY, AMBIENT, DIFFUSE = 12.0, 0.35, 0.65  # fixed: gain of a boundary's slope, shares of light


def by_slab(lines: DataFrame, grid: DataFrame, depth: int = slabs.DEPTH) -> DataFrame:
    """``lines`` (volume_id and ``LINE``) with nx, ny, nz, once for every slab that they cross."""
    at = lambda i: F.least(F.greatest(F.floor(F.col("oz") + F.col("dz") * (F.col("t0") + F.col("dt") * i) + 0.5), F.lit(0).cast("long")), (F.col("nz") - 1).cast("long"))
    ends = [F.floor(at(i) / depth) for i in (F.lit(0), F.col("n") - 1)]
    return slabs.per_volume(lines.filter("n > 0"), grid.select("volume_id", "nx", "ny", "nz")).withColumn("slab", F.explode(F.sequence(F.least(*ends), F.greatest(*ends))))


class Points:
    """The points of lines that lie in one slab, in the order of lines and steps; ``inside``: only those within the volume's box."""

    def __init__(self, s: Slab, t: pa.Table, inside: bool = False):
        ox, oy, oz, dx, dy, dz, t0, dt, n = (t[c].to_numpy().astype(np.float64) for c in LINE)
        start, rise = oz + dz * t0, dz * dt
        flat = np.abs(rise) < 1e-12
        low, high = (-np.inf if s.lo == 0 else s.lo - 0.5), (np.inf if s.hi == s.nz else s.hi - 0.5)
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = ((x - start) / np.where(flat, 1.0, rise) for x in (low, high))
        first = np.where(flat, 0, np.clip(np.floor(np.minimum(a, b)) - 1, 0, n)).astype(np.int64)
        last = np.where(flat, n, np.clip(np.ceil(np.maximum(a, b)) + 2, 0, n)).astype(np.int64)
        size = np.maximum(last - first, 0)
        line = np.repeat(np.arange(len(n)), size)
        step = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + first[line]
        along = t0[line] + step * dt[line]
        x, y, z = (o[line] + d[line] * along for o, d in ((ox, dx), (oy, dy), (oz, dz)))
        k = np.clip(np.floor(z + 0.5), 0, s.nz - 1)
        ok = (k >= s.lo) & (k < s.hi)
        for v, m in ((x, s.nx), (y, s.ny), (z, s.nz)):
            ok &= not inside or (v >= -0.5) & (v <= m - 0.5)
        self.line, self.step, self.along, self.x, self.y, self.z = (v[ok] for v in (line, step, along, x, y, z))


def trilinear(s: Slab, a: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Values of ``a`` (all slices at hand) between voxels; places beyond the volume read its edge."""
    x, y, z = (np.clip(v, 0, m - 1) for v, m in ((x, s.nx), (y, s.ny), (z, s.nz)))
    low = [np.floor(v).astype(np.int64) for v in (x, y, z)]
    high = [np.minimum(v + 1, m - 1) for v, m in zip(low, (s.nx, s.ny, s.nz), strict=True)]
    fx, fy, fz = (v - w for v, w in zip((x, y, z), low, strict=True))
    out = np.zeros(len(x))
    for c, wz in ((low[2], 1 - fz), (high[2], fz)):
        for b, wy in ((low[1], 1 - fy), (high[1], fy)):
            for i, wx in ((low[0], 1 - fx), (high[0], fx)):
                out += wx * wy * wz * a[c - s.base, b, i]
    return out


def projected(lines: DataFrame, voxels: DataFrame, grid: DataFrame, key: str, depth: int = slabs.DEPTH) -> DataFrame:
    """volume_id, ``key``, value, step, x, y, z: the greatest ``value`` along each line, the first step that has it and its place.

    ``voxels`` have volume_id, k, j, i, value. Lines without a point inside are not listed.
    The place (in voxels) comes along, so that nobody needs to meet the lines again.
    """

    def kernel(s: Slab, t: pa.Table) -> pa.Table:
        p = Points(s, t, inside=True)
        value = trilinear(s, s.dense("value"), p.x, p.y, p.z)
        order = np.lexsort((p.step, -value, p.line))
        first = order[np.flatnonzero(np.diff(p.line[order], prepend=-1))]
        return pa.table({"volume_id": pa.array([s.volume_id] * len(first), pa.string()), key: t[key].to_numpy()[p.line[first]], "value": value[first], "step": p.step[first].astype(np.int32), **{c: v[first] for c, v in zip("xyz", (p.x, p.y, p.z), strict=True)}})

    asked = by_slab(lines, grid, depth).select("volume_id", "slab", key, *LINE)
    found = slabs.read_slabs(asked, voxels, grid, kernel, f"volume_id string, {key} long, value double, step int, x double, y double, z double", fields=["value"], halo=1, depth=depth)
    best = found.groupBy("volume_id", key).agg(F.max(F.struct("value", (-F.col("step")).alias("back"), *"xyz")).alias("b"))
    return best.select("volume_id", key, "b.value", (-F.col("b.back")).alias("step"), *(f"b.{c}" for c in "xyz"))


def read_along(lines: DataFrame, voxels: DataFrame, grid: DataFrame, key: str, depth: int = slabs.DEPTH) -> DataFrame:
    """volume_id, ``key``, value of every point of lines, whose key is that of their first point plus the step.

    Only points that fusion reads: between the sample centres in a slice, half a slice beyond the last ones.
    """

    def kernel(s: Slab, t: pa.Table) -> pa.Table:
        p = Points(s, t, inside=True)
        ok = (p.x >= 0) & (p.x <= s.nx - 1) & (p.y >= 0) & (p.y <= s.ny - 1)
        value = trilinear(s, s.dense("value"), p.x[ok], p.y[ok], p.z[ok])
        return pa.table({"volume_id": pa.array([s.volume_id] * len(value), pa.string()), key: t[key].to_numpy()[p.line[ok]] + p.step[ok], "value": value})

    asked = by_slab(lines, grid, depth).select("volume_id", "slab", key, *LINE)
    return slabs.read_slabs(asked, voxels, grid, kernel, f"volume_id string, {key} long, value double", fields=["value"], halo=1, depth=depth)


def plane_lines(pixels: DataFrame, origin: g.Vec, u: g.Vec, v: g.Vec, thickness: float, steps: int, to_voxel: tuple) -> DataFrame:
    """Lines through the pixels of a plane, along its normal.

    ``pixels`` have a, b: millimetres from ``origin`` along ``u`` and ``v``; ``to_voxel`` is
    the affine (12 numbers or columns) from the patient to the volume. One step is the plane itself.
    """
    normal = g.normalize(g.cross(u, v))
    point = tuple(g.col(o) + g.col(x) * F.col("a") + g.col(y) * F.col("b") for o, x, y in zip(origin, u, v, strict=True))
    start = g.apply_affine(to_voxel, point)
    turn = tuple(g.col(to_voxel[4 * r]) * normal[0] + g.col(to_voxel[4 * r + 1]) * normal[1] + g.col(to_voxel[4 * r + 2]) * normal[2] for r in range(3))
    t0, dt = (-thickness / 2, thickness / (steps - 1)) if steps > 1 else (0.0, 0.0)
    own = {**dict(zip(LINE[:3], start, strict=True)), **dict(zip(LINE[3:6], turn, strict=True)), "t0": F.lit(t0), "dt": F.lit(dt), "n": F.lit(steps)}
    return pixels.withColumns(own)


def rays(cameras: DataFrame, grid: DataFrame, step: float) -> DataFrame:
    """Lines of rays (volume_id, ox, oy, oz, tx, ty, tz in voxels: from o through t) within the box of their volume.

    A ray that misses its box, or has no direction, has no points; none has more than ``MOST_STEPS``.
    """
    sized = slabs.per_volume(cameras, grid.select("volume_id", "nx", "ny", "nz"))
    o, d = (tuple(F.col(a + c) for c in "xyz") for a in "od")
    # column by column, so that no expression holds another one many times
    sized = sized.withColumns({"d" + c: F.col("t" + c) - F.col("o" + c) for c in "xyz"}).withColumn("length", g.length(d))
    sized = sized.withColumns({"d" + c: F.coalesce(F.try_divide("d" + c, "length"), F.lit(0.0)) for c in "xyz"})
    slope = tuple(F.when(F.abs(x) < 1e-300, 1e-300).otherwise(x) for x in d)
    _, near, far = views.ray_box(o, slope, tuple(F.col(c) for c in ("nx", "ny", "nz")))
    sized = sized.withColumns({"near": near, "far": far}).withColumn("t0", F.greatest("near", F.lit(0.0)))
    n = F.when((F.col("far") > F.col("t0")) & (F.col("length") > 0), F.least(F.floor((F.col("far") - F.col("t0")) / step) + 1, F.lit(MOST_STEPS).cast("long"))).otherwise(0)
    return sized.withColumns({"dt": F.lit(step), "n": n.cast("int")}).drop("nx", "ny", "nz", "near", "far", "length")


def march(
    lines: DataFrame,
    voxels: DataFrame,
    grid: DataFrame,
    key: str,
    *,
    center: float,
    width: float,
    opacity: float,
    threshold: float = 0.0,
    edge_boost: float = 0.0,
    light: float = 0.0,
    clip: tuple[tuple[float, float, float, float], ...] = (),
    depth: int = slabs.DEPTH,
) -> DataFrame:
    """volume_id, ``key``, alpha, gray, stop: what each of the ``rays`` adds up front to back.

    A sample counts by how far its windowed value is above ``threshold`` (squared), by the
    slope there as far as ``edge_boost`` asks for it, and by the length of a step; its gray
    is shaded by the slope's direction as far as ``light`` asks. ``clip``: half spaces
    (x, y, z, w of voxel coordinates) whose positive side is cut away. The ray ends when
    nearly opaque; ``stop`` is how far along it that is, null for a ray that passes through.
    Rays that meet nothing have alpha and gray 0.
    """

    def windowed(v: np.ndarray) -> np.ndarray:
        return np.clip((v - (center - width / 2)) / max(width, 1e-6), 0.0, 1.0)

    def kernel(s: Slab, t: pa.Table) -> pa.Table:
        a, p = s.dense("value"), Points(s, t)
        at = (p.x, p.y, p.z)
        gray = windowed(trilinear(s, a, *at))
        ok = gray > threshold
        for x, y, z, w in clip:
            ok &= x * p.x + y * p.y + z * p.z + w <= 0
        line, gray, along, step = p.line[ok], gray[ok], p.along[ok], p.step[ok]
        at = [v[ok] for v in at]
        slope = np.stack([windowed(trilinear(s, a, *(v + (m == n) for m, v in enumerate(at)))) - windowed(trilinear(s, a, *(v - (m == n) for m, v in enumerate(at)))) for n in range(3)])
        size = np.sqrt((slope * slope).sum(axis=0))
        unit = np.where(size > 1e-5, slope / np.where(size > 1e-5, size, 1.0), np.array([[0.0], [0.0], [1.0]]))
        above = (gray - threshold) / max(1.0 - threshold, 1e-4)
        boundary = 1 + (np.clip(size * BOUNDARY, 0.0, 1.0) - 1) * edge_boost
        alpha = np.clip(above * above * boundary * opacity * t["dt"].to_numpy()[line], 0.0, 1.0)
        lambert = np.abs(sum(unit[n] * t[c].to_numpy()[line] for n, c in enumerate(("dx", "dy", "dz"))))
        gray = gray * (1 + (AMBIENT + DIFFUSE * lambert - 1) * light)
        seen = alpha > FAINT
        line, gray, along, step, alpha = (v[seen] for v in (line, gray, along, step, alpha))
        sizes = np.bincount(line, minlength=len(t))
        lists = {n: pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], v).cast(pa.list_(k)) for n, v, k in (("steps", step.astype(np.int32), pa.int32()), ("alphas", alpha, pa.float64()), ("grays", gray, pa.float64()), ("places", along, pa.float64()))}
        return pa.table({"volume_id": t["volume_id"], key: t[key], **lists})

    asked = by_slab(lines, grid, depth).select("volume_id", "slab", key, *LINE)
    out = f"volume_id string, {key} long, steps array<int>, alphas array<double>, grays array<double>, places array<double>"
    found = slabs.read_slabs(asked, voxels, grid, kernel, out, fields=["value"], halo=2, depth=depth)
    samples = found.groupBy("volume_id", key).agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("steps", "alphas", "grays", "places")))).alias("s"))

    def add(acc: Column, x: Column) -> Column:
        left = 1 - acc["alpha"]
        alpha = acc["alpha"] + left * x["alphas"]
        done = acc["alpha"] > OPAQUE
        more = F.struct(alpha.alias("alpha"), (acc["gray"] + left * x["alphas"] * x["grays"]).alias("gray"), F.when(alpha > OPAQUE, x["places"]).alias("stop"))
        return F.when(done, acc).otherwise(more)

    nothing = F.struct(F.lit(0.0).alias("alpha"), F.lit(0.0).alias("gray"), F.lit(None).cast("double").alias("stop"))
    folded = samples.select("volume_id", key, F.aggregate("s", nothing, add).alias("f")).select("volume_id", key, "f.*")
    every = lines.select("volume_id", key).join(folded, ["volume_id", key], "left")
    return every.select("volume_id", key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("alpha", "gray")), "stop")
