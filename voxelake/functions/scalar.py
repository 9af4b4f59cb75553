"""Scalar column functions: rounding, bits, windows, tags, value text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round half toward plus infinity (Spark's round goes away from zero)."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def bit_mask(v: Column, allocated: int, stored: int, high_bit: int, signed: bool) -> Column:
    """The stored bits of a sample, sign-extended if asked; nothing to do when all bits are stored."""
    if stored >= allocated:
        return v
    x = F.shiftright(v, high_bit + 1 - stored).bitwiseAND(F.lit((1 << stored) - 1))
    return F.when(x >= 1 << (stored - 1), x - (1 << stored)).otherwise(x) if signed else x


def rescale(v: Column, slope: float, intercept: float) -> Column:
    return (v * F.lit(float(slope)) + F.lit(float(intercept))).cast("float")


def window_level(v: Column, center, width, invert: bool = False) -> Column:
    """A stored value on the 0..1 scale of a display window."""
    c, w = (x if isinstance(x, Column) else F.lit(float(x)) for x in (center, width))
    x = clamp((v - (c - w / 2)) / F.greatest(w, F.lit(1e-6)), 0.0, 1.0)
    return 1 - x if invert else x


def to_signal(fraction: Column, low: Column, high: Column) -> Column:
    return clamp((fraction - low) / F.greatest(high - low, F.lit(1e-6)), 0.0, 1.0)


# --- tags: one LONG, group * 65536 + element ---


def tag(group: Column, element: Column) -> Column:
    return group.cast("long") * 65536 + element


def tag_group(t: Column) -> Column:
    return F.floor(t / 65536)


def tag_element(t: Column) -> Column:
    return F.pmod(t, F.lit(65536))


def format_tag(t: Column) -> Column:
    return F.format_string("(%04x,%04x)", tag_group(t), tag_element(t))


def is_private(t: Column) -> Column:
    return tag_group(t) % 2 == 1


def is_group_length(t: Column) -> Column:
    return tag_element(t) == 0


# --- value text ---


def element_text(raw: Column) -> Column:
    """Text of an element: trailing spaces and NULs go, nothing left is no value."""
    return F.nullif(F.regexp_replace(raw, "[ \\x00]+$", ""), F.lit(""))


def element_strings(raw: Column) -> Column:
    return F.transform(F.split(element_text(raw), r"\\"), F.trim)


def element_numbers(raw: Column) -> Column:
    """Numbers of a multi-valued text; an empty part counts as 0, other non-numbers are left out."""
    number = lambda x: F.when(x == "", F.lit(0.0)).otherwise(F.expr("null").cast("double") if x is None else x.try_cast("double"))
    return F.filter(F.transform(element_strings(raw), number), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def format_bytes(n: Column) -> Column:
    """Decimal sizes as shown to people."""
    return F.when(n >= 1_000_000_000, F.format_string("%.2f GB", n / 1e9)).when(n >= 1_000_000, F.format_string("%.0f MB", n / 1e6)).otherwise(F.format_string("%.0f kB", n / 1e3))


def linear_channel(c: Column) -> Column:
    """An sRGB channel (0..255) as linear light."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def luminance(hex_color: Column) -> Column:
    """Relative luminance of "#rrggbb"."""
    part = lambda i: linear_channel(F.conv(F.substring(hex_color, i, 2), 16, 10).cast("double"))
    return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)


def contrast(a: Column, b: Column) -> Column:
    hi, lo = F.greatest(luminance(a), luminance(b)), F.least(luminance(a), luminance(b))
    return (hi + 0.05) / (lo + 0.05)


#: Linear light to cone responses, and their cube roots to lightness and two opponents (fixed values of the public colour space).
CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OPPONENTS = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))


def oklab(hex_color: Column) -> tuple[Column, Column, Column]:
    """Lightness and the two colour axes of "#rrggbb" where distances are as the eye sees them."""
    light = [linear_channel(F.conv(F.substring(hex_color, i, 2), 16, 10).cast("double")) for i in (2, 4, 6)]
    weighed = lambda rows, v: [sum((w * x for w, x in zip(row[1:], v[1:], strict=True)), row[0] * v[0]) for row in rows]
    return tuple(weighed(OPPONENTS, [F.cbrt(x) for x in weighed(CONES, light)]))


def colour_distance(a: Column, b: Column) -> Column:
    off = [x - y for x, y in zip(oklab(a), oklab(b), strict=True)]
    return F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])


def progress(done: Column, total: Column) -> tuple[Column, Column]:
    """Summed progress, and its share of the summed totals; no share while any total is unknown."""
    known = F.bool_and(total.isNotNull()) & (F.sum(total) > 0)
    return F.sum(done), F.when(known, F.least(F.lit(1.0), F.sum(done) / F.sum(total)))
