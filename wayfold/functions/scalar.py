"""Scalar functions on columns: activations, scores, classes, angles, bins and rotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.params import DEFAULTS, Parameters


def activation_linear(x: Column, lo: float | Column, hi: float | Column, rising: bool = True) -> Column:
    """0 below lo, 1 above hi and a line between (the mirror image if not rising), to 3 decimals; null stays null. Where lo equals hi, x there counts as below."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    share = F.when(x < lo, 0.0).when(x > hi, 1.0).when(x.isNotNull(), F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)))
    return F.round(share if rising else 1.0 - share, 3)


def activation_steps(x: Column, at: tuple[float, ...], rising: bool = True) -> Column:
    """Equal steps from 0 to 1 (or 1 to 0) at ascending thresholds, the last of which ends them; null gives 0, to 3 decimals."""
    k = len(at)
    level = [i / k for i in range(k + 1)]
    if not rising:
        level = [1 - v for v in level]
    out = F.when(x < at[0], level[0])
    for i in range(1, k):
        out = out.when(x < at[i], level[i])
    return F.round(F.coalesce(out.when(x >= at[-1], level[-1]), F.lit(0.0)), 3)


def interval(x: Column, breaks: Column, n: int) -> Column:
    """How many of the n ascending breaks are at or below x."""
    return reduce(lambda a, b: a + b, (F.when(x >= F.get(breaks, i), 1).otherwise(0) for i in range(n)))


def road_class(score: Column) -> Column:
    """1 to 4 by quarters of the score from above; null for null."""
    return F.when(score < 25, 4).when(score < 50, 3).when(score < 75, 2).when(score <= 101, 1)


def road_score(veg: Column, width: Column, conductivity: Column, shoulders: Column, p: Parameters = DEFAULTS) -> Column:
    """100 times the mean of four activations, to 1 decimal."""
    s = p.state
    parts = [activation_linear(veg, *s.percentage_veg, rising=False), activation_linear(width, *s.drivable_width), activation_linear(conductivity, *s.conductivity), activation_linear(shoulders, *s.shoulder)]
    return F.round(F.round(100 * reduce(lambda a, b: a + b, parts) / 4, 9), 1)


def angle_gap(a: Column, b: Column) -> Column:
    """The lesser angle between two headings in degrees."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def turn(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """The angle in degrees between two vectors; 0 for all but parallel ones, null where one is zero."""
    r = F.try_divide(ux * vx + uy * vy, F.hypot(ux, uy) * F.hypot(vx, vy))
    return F.when(r > 0.999999999, 0.0).otherwise(F.degrees(F.acos(F.greatest(r, F.lit(-1.0)))))


def round_any(x: Column, step: float) -> Column:
    return F.round(x / step) * step


def rotate(x: Column, y: Column, cx: Column, cy: Column, angle: Column, scale: float = 0.01) -> tuple[Column, Column]:
    """Coordinates along and across an axis through (cx, cy) at `angle`, in whole scale steps."""
    dx, dy = x - cx, y - cy
    return round_any(dx * F.cos(angle) + dy * F.sin(angle), scale), round_any(dy * F.cos(angle) - dx * F.sin(angle), scale)


def unrotate(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> tuple[Column, Column]:
    return cx + x * F.cos(angle) - y * F.sin(angle), cy + x * F.sin(angle) + y * F.cos(angle)


def slice_angle(dx: Column, dy: Column) -> Column:
    """A segment's direction in [0, pi)."""
    a = F.when(dx == 0, F.lit(3.141592653589793 / 2)).otherwise(F.atan(F.try_divide(dy, dx)))
    return F.when(a < 0, a + 3.141592653589793).otherwise(a)


def sigma_v1(s: Column, low: Column, e: Column, d: Column, h: Column, r: Column, i: Column, p: Parameters = DEFAULTS, use_intensity: bool = True) -> Column:
    c = p.conductivity
    ai = c.alpha_i if use_intensity else 0
    sigma = s * low * e * (c.alpha_d * d + c.alpha_h * h + c.alpha_r * r + ai * i) / float(c.alpha_d + c.alpha_h + c.alpha_r + ai)
    return F.when(sigma < c.sigma_min, F.lit(c.sigma_min)).otherwise(sigma)


def sigma_v2(e: Column, d: Column, h: Column, r: Column, i: Column, p: Parameters = DEFAULTS, use_intensity: bool = True) -> Column:
    c = p.conductivity
    ai = c.alpha_i if use_intensity else 0
    return (e + c.alpha_d * d + c.alpha_h * h + c.alpha_r * r + ai * i) / float(c.alpha_d + c.alpha_h + c.alpha_r + ai + 1)


def buffer_near_closed(distance: Column, buffer: float) -> Column:
    """A road's buffer, less where its ends are nearer than two buffers."""
    return F.when(distance < 2 * buffer, distance * buffer / (2 * buffer + 5)).otherwise(F.lit(float(buffer)))


def split_count(length: Column, longest: float, loop: Column) -> Column:
    """In how many pieces a road is cut: one more than the longest length fits in it, and at least two for a loop."""
    cuts = F.floor(length / longest).cast("int")
    return F.when(loop & (cuts == 0), 1).otherwise(cuts) + 1
