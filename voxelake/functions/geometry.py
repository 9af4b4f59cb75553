"""Patient-space geometry as column expressions.

A vector is a tuple of three columns (or numbers); an affine is twelve numbers or
columns, rows of a 3x4 matrix. Coordinates: +x Left, +y Posterior, +z Superior, in mm.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple

#: The six anatomical directions in their fixed order (ties go to the earlier).
AXES = (("R", (-1, 0, 0)), ("L", (1, 0, 0)), ("A", (0, -1, 0)), ("P", (0, 1, 0)), ("I", (0, 0, -1)), ("S", (0, 0, 1)))


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(col(x) + col(y) for x, y in zip(a, b, strict=True))


def subtract(a: Vec, b: Vec) -> Vec:
    return tuple(col(x) - col(y) for x, y in zip(a, b, strict=True))


def scale(a: Vec, s) -> Vec:
    return tuple(col(x) * col(s) for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return col(a[0]) * col(b[0]) + col(a[1]) * col(b[1]) + col(a[2]) * col(b[2])


def cross(a: Vec, b: Vec) -> Vec:
    (ax, ay, az), (bx, by, bz) = (tuple(map(col, v)) for v in (a, b))
    return (ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return length(subtract(a, b))


def normalize(a: Vec) -> Vec:
    """A zero vector stays as it is."""
    n = length(a)
    return tuple(F.when(n == 0, col(x)).otherwise(col(x) / n) for x in a)


def is_finite(a: Vec) -> Column:
    out = F.lit(True)
    for x in a:
        out = out & ~F.isnan(col(x)) & (F.abs(col(x)) < float("inf"))
    return out


def affine_from_axes(x: Vec, y: Vec, z: Vec, origin: Vec) -> tuple:
    return tuple(v for r in range(3) for v in (x[r], y[r], z[r], origin[r]))


def apply_affine(m: tuple, p: Vec) -> Vec:
    return tuple(col(m[4 * r]) * col(p[0]) + col(m[4 * r + 1]) * col(p[1]) + col(m[4 * r + 2]) * col(p[2]) + col(m[4 * r + 3]) for r in range(3))


def invert_affine(m: tuple) -> tuple:
    """The inverse by cofactors; a singular affine has null entries."""
    a, b, c, tx, d, e, f, ty, g, h, i, tz = map(col, m)
    c00, c01, c02 = e * i - f * h, c * h - b * i, b * f - c * e
    c10, c11, c12 = f * g - d * i, a * i - c * g, c * d - a * f
    c20, c21, c22 = d * h - e * g, b * g - a * h, a * e - b * d
    det = F.nullif(a * c00 + b * c10 + c * c20, F.lit(0.0))
    rows = ((c00, c01, c02), (c10, c11, c12), (c20, c21, c22))
    out = []
    for r in rows:
        x, y, z = (v / det for v in r)
        out += [x, y, z, -(x * tx + y * ty + z * tz)]
    return tuple(out)


def nearest_axis(d: Vec) -> Column:
    """Code of the anatomical direction closest to a vector."""
    u = normalize(d)
    best = F.greatest(*(dot(u, v) for _, v in AXES))
    out = F.lit(None).cast("string")
    for code, v in reversed(AXES):
        out = F.when(dot(u, v) == best, code).otherwise(out)
    return out


def describe_direction(d: Vec, threshold: float = 0.5) -> Column:
    """Direction letters, strongest first, weak ones left out."""
    u = normalize(d)
    scored = F.array(*(F.struct((-dot(u, v)).alias("s"), F.lit(n).alias("n"), F.lit(code).alias("code")) for n, (code, v) in enumerate(AXES)))
    kept = F.array_sort(F.filter(scored, lambda x: x["s"] < 0))
    strong = F.get(kept, F.lit(0))["s"]
    return F.array_join(F.transform(F.filter(kept, lambda x: x["s"] <= strong * threshold), lambda x: x["code"]), "")


def describe_plane(n: Vec, tolerance: float = 0.9) -> Column:
    x, y, z = normalize(n)
    return F.when(F.abs(z) >= tolerance, "axial").when(F.abs(y) >= tolerance, "coronal").when(F.abs(x) >= tolerance, "sagittal").otherwise("oblique")


def edge_labels(row: Vec, column: Vec) -> dict[str, Column]:
    flip = lambda v: tuple(-col(x) for x in v)
    return {"top": describe_direction(flip(column)), "bottom": describe_direction(column), "left": describe_direction(flip(row)), "right": describe_direction(row)}


def inside(voxel: Vec, dims: Vec) -> Column:
    """Within half a voxel of the grid (the trilinear rule), ends included."""
    out = F.lit(True)
    for v, n in zip(voxel, dims, strict=True):
        out = out & (col(v) >= -0.5) & (col(v) <= col(n) - 0.5)
    return out


def inside_for_fusion(voxel: Vec, dims: Vec) -> Column:
    """Between sample centres in the slice, within half a slice across it."""
    (x, y, z), (nx, ny, nz) = voxel, dims
    return (col(x) >= 0) & (col(y) >= 0) & (col(z) >= -0.5) & (col(x) <= col(nx) - 1) & (col(y) <= col(ny) - 1) & (col(z) <= col(nz) - 0.5)


def clipped(p: Vec, planes: list[tuple[float, float, float, float]]) -> Column:
    """Whether a point lies on the positive side of any enabled plane (a, b, c, d)."""
    out = F.lit(False)
    for a, b, c, d in planes:
        out = out | (dot(p, (a, b, c)) + col(d) > 0)
    return out
