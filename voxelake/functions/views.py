"""View rules as columns: planes, frames, gestures, plans, limits, paging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelake.functions import geometry as g

#: The three standard planes: right, down and normal directions.
PLANES = {"axial": ((1, 0, 0), (0, 1, 0), (0, 0, 1)), "coronal": ((1, 0, 0), (0, 0, -1), (0, 1, 0)), "sagittal": ((0, 1, 0), (0, 0, -1), (1, 0, 0))}


def in_planes(p: g.Vec) -> Column:
    """One struct a plane: its name, the point's place in it and its depth."""
    return F.array(*(F.struct(F.lit(n).alias("plane"), g.dot(p, u).alias("u"), g.dot(p, v).alias("v"), g.dot(p, w).alias("depth")) for n, (u, v, w) in PLANES.items()))


def fit_span(size: tuple, pane: tuple, zoom: Column) -> tuple[Column, Column]:
    """Millimetres that a pane shows of a plane fitted into it."""
    (w, h), (pw, ph) = (tuple(map(g.col, x)) for x in (size, pane))
    aspect = pw / F.greatest(ph, F.lit(1.0))
    wide = w / F.greatest(h, F.lit(1e-6)) > aspect
    return F.when(wide, w).otherwise(h * aspect) / zoom, F.when(wide, w / aspect).otherwise(h) / zoom


def slice_frame(size: tuple, spacing: tuple, most: int) -> tuple[Column, Column]:
    """Pixels of a slice picture: half the finest step each, no side over ``most``."""
    pitch = F.least(*map(g.col, spacing)) / 2
    w, h = g.col(size[0]) / pitch, g.col(size[1]) / pitch
    shrink = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h, F.lit(1.0)))
    return tuple(F.greatest(F.floor(x * shrink + 0.5), F.lit(1)) for x in (w, h))


def to_patient(x: Column, y: Column, pane: tuple, span: tuple) -> tuple[Column, Column]:
    """A pixel of a pane as millimetres right and down from its middle."""
    return (x / g.col(pane[0]) - 0.5) * span[0], (y / g.col(pane[1]) - 0.5) * span[1]


def gesture(button: Column, shift: Column, alt: Column, volume: Column) -> Column:
    return F.when((button == 2) | shift, "window").when((button == 1) | alt, "pan").when(volume, "orbit").otherwise("crosshair")


def model_plan(gpu: Column, buffer: Column, mobile: Column, least: int) -> Column:
    """The model a device can carry; null for none."""
    return F.when(gpu, F.when(buffer >= least, "large").otherwise("small")).when(~mobile, "slim")


def window_limits(lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Lowest and highest centre, and widest window, of a slider over a stored range."""
    span = F.greatest(hi - lo, F.lit(1.0))
    return lo - span * 0.1, hi + span * 0.1, span * 1.5


def next_step(step: Column, n: int) -> tuple[Column, Column]:
    return F.least(step + 1, F.lit(n - 1)), step + 1 >= n


def previous_step(step: Column) -> Column:
    return F.greatest(F.lit(0), step - 1)



def same_cut(a: Column, b: Column, thickness: float) -> Column:
    """Whether two depths lie in one slab."""
    return F.abs(a - b) <= thickness / 2 + 1e-9


def same_frame(a: Column, b: Column) -> Column:
    """Whether two series share a frame of reference; an empty one is none."""
    return F.coalesce((a != "") & (a == b), F.lit(False))


def outside(p: g.Vec, low: tuple, high: tuple) -> Column:
    """Whether a point lies outside a box."""
    return ~(p[0].between(low[0], high[0]) & p[1].between(low[1], high[1]) & p[2].between(low[2], high[2]))


def ray_box(origin: g.Vec, direction: g.Vec, dims: tuple) -> tuple[Column, Column, Column]:
    """Whether a ray meets a grid's box ahead of it, and where along the ray it enters and leaves."""
    enter, leave = [], []
    for o, d, n in zip(origin, direction, map(g.col, dims), strict=True):
        sides = ((F.lit(-0.5) - o) / d, (n - 0.5 - o) / d)
        enter.append(F.least(*sides))
        leave.append(F.greatest(*sides))
    near, far = F.greatest(*enter), F.least(*leave)
    return far > F.greatest(near, F.lit(0.0)), near, far


def mm_per_pixel(span: tuple[Column, Column], pane: tuple) -> tuple[Column, Column]:
    """Millimetres that a pixel of a pane covers each way."""
    return tuple(s / F.greatest(g.col(p), F.lit(1)) for s, p in zip(span, pane, strict=True))


#: The orientation cube's largest size and its margin, in pixels (fixed values).
CUBE, CUBE_MARGIN = 132, 12


def cube_viewport(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Left, top and size of the orientation cube in the upper right of a pane."""
    size = F.least(F.lit(CUBE), F.floor(F.least(width, height) * 0.4))
    return x + width - size - CUBE_MARGIN, y + CUBE_MARGIN, size


def step_shown(step: Column, n: int) -> tuple[Column, Column]:
    """The step to show of ``n``, and the number told to people."""
    return F.least(F.greatest(step, F.lit(0)), F.lit(n - 1)), step + 1


def saved_step(raw: Column) -> tuple[Column, Column]:
    """Step and whether finished of a saved state; null, broken text and other values than an object are a first visit."""
    kind = lambda field: F.trim(F.get_json_object(raw, field))
    known = F.coalesce(raw.rlike(r"^\s*\{"), F.lit(False)) & F.from_json(raw, "step string, finished string", {"mode": "PERMISSIVE"}).isNotNull()
    step = kind("$.step").try_cast("double")
    quoted = raw.rlike(r'"step"\s*:\s*"')
    fine = known & step.isNotNull() & ~F.isnan(step) & ~quoted
    finished = F.coalesce(known & (kind("$.finished") == "true") & ~raw.rlike(r'"finished"\s*:\s*"'), F.lit(False))
    return F.when(F.coalesce(fine, F.lit(False)), step).otherwise(0.0), finished
