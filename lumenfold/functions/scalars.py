"""Scalar functions on pixels, angles and geometry. IEEE results where plain SQL would raise or give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
SMALLEST_NORMAL = 1.17549435e-38  # of 32-bit floats (fixed value)
TWO_PI = 2 * math.pi


def minus_log(x: Column) -> Column:
    """-ln x; +inf at 0, NaN below."""
    return F.when(F.isnan(x), NAN).when(x > 0, -F.ln(x)).when(x == 0, INF).otherwise(NAN)


def remove_invalids(x: Column) -> Column:
    """0 for NaN, negatives and +inf."""
    return F.when(F.isnan(x) | (x < 0) | (x == INF), 0.0).otherwise(x)


def remove_abnormals(x: Column) -> Column:
    """0 for all that isn't a normal 32-bit float: NaN, infinities, subnormals."""
    return F.when(F.isnan(x) | (F.abs(x) == INF) | (F.abs(x) < SMALLEST_NORMAL), 0.0).otherwise(x)


def remove_negatives(x: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(x)


def remove_nans(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(x)


def pv_angle(start: float, uid: Column, flats: Column, darks: Column, delta: float) -> Column:
    """Degrees of the uid-th frame; the start counts in steps too."""
    return F.pmod((F.lit(start) + (uid - (flats + darks)).cast("double")) * F.lit(delta), F.lit(360.0))


def quadrant(theta: Column) -> Column:
    """1 in the first and third quarter of a turn, else 0; any angle."""
    t = F.pmod(theta, F.lit(TWO_PI))
    return F.when((t < math.pi / 2) | ((t >= math.pi) & (t < 3 * math.pi / 2)), 1).otherwise(0)


def center_or(center: Column, n: Column, rule: str) -> Column:
    """The rotation center, or its default: reconstruct (n / 2 + 1 unless positive), distribute (n / 2 for 0), serialise (n / 2 for null)."""
    half = n.cast("double") / 2
    return {"reconstruct": F.when(center > 0, center).otherwise(half + 1), "distribute": F.when(center == 0, half).otherwise(center), "serialise": F.coalesce(center, half)}[rule]


def center_override(center: Column, given: float) -> Column:
    """The center given for a run, cut to a whole number, unless that is 0: then the message's own."""
    return F.lit(float(int(given))) if int(given) else center


def mov(center: Column, n: Column) -> Column:
    """Shift of the detector to the center, for the simultaneous solver."""
    return n.cast("double") / 2 - center + F.lit(1e-6)


def mov_sequential(center: Column, n: Column) -> Column:
    """The same for the sequential solver: off whole numbers by at least 0.01, and by half a pixel."""
    m = (n - 1) * F.lit(0.5) - center
    return F.when(m - F.floor(m) < 0.01, m + F.lit(0.01)).otherwise(m) + F.lit(0.5)


def crossings(theta_deg: Column, cols: int) -> Column:
    """Grid lines that a projection of `cols` columns crosses, about."""
    t = F.radians(theta_deg)
    return (F.abs(F.sin(t)) + F.abs(F.cos(t))) * F.lit(float(cols * cols))


def crossing_cost(theta_deg: Column, cols: int) -> Column:
    return crossings(theta_deg, cols) * (F.abs(F.sin(F.radians(theta_deg))) + 1)


def min_max(px: Column, scale: float = 1.0) -> Column:
    """An image rescaled to 0 .. scale; all 0 if it is constant."""
    lo, hi = F.array_min(px), F.array_max(px)
    return F.transform(px, lambda v: F.when(hi > lo, (v - lo) / (hi - lo) * scale).otherwise(0.0))


def quantised(px: Column) -> Column:
    """0 .. 1 to whole 0 .. 255, cut off."""
    return F.transform(px, lambda v: F.floor(v * 255).cast("int"))


def transposed(px: Column, side: int) -> Column:
    return F.transform(px, lambda v, k: F.get(px, (k % side) * side + F.floor(k / side).cast("int")))


def swapped_axes(px: Column, sizes: tuple[int, int, int], one: int, two: int) -> Column:
    """A flat volume (sizes of axes 0, 1, 2) with two axes swapped; the same two pairs in either order."""
    order = [0, 1, 2]
    order[one], order[two] = order[two], order[one]
    stride = (sizes[1] * sizes[2], sizes[2], 1)
    a, b, c = (sizes[k] for k in order)
    place = lambda k: [F.floor(k / (b * c)), F.floor(k / c) % b, k % c]
    source = lambda k: sum((x * stride[o] for x, o in zip(place(k), order, strict=True)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(a * b * c - 1)), lambda k: F.get(px, source(k)))


def halved(px: Column, side: int) -> Column:
    """A square image at half the side: means of 2 x 2 pixels, an odd last row or column left out."""
    half, at = side // 2, lambda k, dy, dx: F.get(px, ((F.floor(k / (side // 2)) * 2 + dy) * side + (k % (side // 2)) * 2 + dx).cast("int"))
    mean = lambda k: (at(k, 0, 0) + at(k, 0, 1) + at(k, 1, 0) + at(k, 1, 1)) / 4.0
    return F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), mean)


def in_circle(x: Column, y: Column, n: int, ratio: float = 0.95) -> Column:
    """Whether a pixel's center is in the circle of `ratio` times the half side."""
    c = (n - 1) / 2
    return (x - c) * (x - c) + (y - c) * (y - c) <= (ratio * n / 2) ** 2
