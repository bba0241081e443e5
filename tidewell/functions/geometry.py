"""Columns on the plane: ellipses, viewport algebra, deterministic unit hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_RADIUS = 1e-6


def compactness(rx: Column, ry: Column, n: Column) -> Column:
    """Area for each member."""
    return F.lit(math.pi) * rx * ry / F.greatest(n, F.lit(1))


def ellipse(x: str, y: str) -> dict[str, Column]:
    """Aggregates cx, cy, rx, ry, angle of the two-sigma covariance ellipse; under two points the radii are tiny."""
    a, c, b = F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)
    middle, spread = (a + c) / 2, F.hypot((a - c) / 2, b)
    few = F.count(x) < 2
    radius = lambda v: F.when(few, SMALL_RADIUS).otherwise(F.greatest(F.lit(2.0) * F.sqrt(F.greatest(v, F.lit(0.0))), F.lit(SMALL_RADIUS)))
    return {"cx": F.avg(x), "cy": F.avg(y), "rx": radius(middle + spread), "ry": radius(middle - spread), "angle": F.when(few, 0.0).otherwise(F.atan2(2 * b, a - c) / 2)}


def in_ellipse(x: Column, y: Column, cx: Column, cy: Column, rx: Column, ry: Column, angle: Column) -> Column:
    dx, dy = x - cx, y - cy
    u, v = dx * F.cos(angle) + dy * F.sin(angle), dy * F.cos(angle) - dx * F.sin(angle)
    floor = F.lit(1e-9)
    return F.pow(u / F.greatest(rx, floor), F.lit(2)) + F.pow(v / F.greatest(ry, floor), F.lit(2)) <= 1


def perimeter(cx: Column, cy: Column, rx: Column, ry: Column, angle: Column, n: int) -> Column:
    """array<struct<x, y>> of points on an ellipse, three at least."""
    n = max(3, n)

    def point(i: Column) -> Column:
        t = i * (2 * math.pi / n)
        u, v = rx * F.cos(t), ry * F.sin(t)
        return F.struct((cx + u * F.cos(angle) - v * F.sin(angle)).alias("x"), (cy + u * F.sin(angle) + v * F.cos(angle)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def stretched(value: Column, low: Column, high: Column) -> Column:
    """From low..high, an extent of 1e-6 at least, to -1..1 around the centre."""
    return (value - (low + high) / 2) * 2 / F.greatest(high - low, F.lit(1e-6))


def stretched_angle(angle: Column, sx: Column, sy: Column) -> Column:
    return F.atan2(sy * F.sin(angle), sx * F.cos(angle))


def fit_scale(width: Column, height: Column, view_width: float, view_height: float) -> Column:
    """The scale at which bounds just fit a view."""
    return F.least(F.lit(view_width) / F.greatest(width, F.lit(1e-6)), F.lit(view_height) / F.greatest(height, F.lit(1e-6)))


def to_screen(world: Column, centre: Column, scale: Column, view: float) -> Column:
    return (world - centre) * scale + view / 2


def centrality_radius(cluster: Column, centrality: Column, least: float, most: float, gamma: float) -> Column:
    """Noise has radius 1."""
    clamped = F.least(F.greatest(F.coalesce(centrality, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(cluster < 0, 1.0).otherwise(least + (most - least) * F.pow(clamped, F.lit(gamma)))


def lerp(a: Column, b: Column, t: float) -> Column:
    return a + (b - a) * t


def unit_hash(value: Column) -> Column:
    """A 32-bit finaliser as a number from 0 to 1."""
    mask = F.lit(0xFFFFFFFF)

    def times(h: Column, factor: int) -> Column:
        low, high = F.lit(factor & 0xFFFF), F.lit(factor >> 16)
        return (h * low + F.shiftleft((h * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)

    h = value.cast("long").bitwiseAND(mask)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = times(h.bitwiseXOR(F.shiftrightunsigned(h, shift)), factor)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    return h / F.lit(4294967295.0)


def adaptive_rate(duration: Column, default: float = 1.0) -> Column:
    """Frames a second: 3 under 15 s, 2 up to 45 s, else 1."""
    return F.when(duration.isNull(), default).when(duration < 15, 3.0).when(duration <= 45, 2.0).otherwise(1.0)


def retry_schedule(initial: Column, caps: tuple[int, ...]) -> Column:
    """The first cap and the smaller ones that follow it, once each, falling."""
    steps = F.array(initial, *[F.lit(c) for c in sorted(caps, reverse=True)])
    return F.array_distinct(F.filter(steps, lambda c: c <= initial))
