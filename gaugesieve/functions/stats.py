"""Two-sided p-value of a correlation as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_STEPS = 400  # half steps of the continued fraction; it settles within 100 where it is used
SHIFT = 24  # steps up before the gamma ratio's series in 1 / a is used
GAMMA_SERIES = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)
SMALLEST = 1e-300


def _away_from_zero(v: Column) -> Column:
    return F.when(F.abs(v) > SMALLEST, v).otherwise(F.lit(SMALLEST))


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a > 0: its series at a + SHIFT, brought down by the recurrence."""
    high = a + SHIFT
    series = F.sqrt(high) * sum((F.lit(c) * F.pow(high, F.lit(float(-k))) for k, c in enumerate(GAMMA_SERIES)), F.lit(0.0))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda p, i: p * (a + i) / (a + i + 0.5))
    return series * down


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, a fixed number of half steps of the modified Lentz method."""
    first = 1.0 / _away_from_zero(1.0 - (a + b) * x / (a + 1.0))

    def step(state: Column, i: Column) -> Column:
        m = F.floor((i + 1) / 2).cast("double")
        top = F.when(i % 2 == 1, m * (b - m)).otherwise(-(a + m) * (a + b + m))
        bottom = F.when(i % 2 == 1, (a + 2 * m - 1) * (a + 2 * m)).otherwise((a + 2 * m) * (a + 2 * m + 1))
        return _advance(state, top * x / bottom)

    def _advance(state: Column, factor: Column) -> Column:
        d = 1.0 / _away_from_zero(1.0 + factor * state["d"])
        c = _away_from_zero(1.0 + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["value"] * d * c).alias("value"))

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step, lambda s: s["value"])


def correlation_p_value(r: Column | str, n: Column | str) -> Column:
    """P(|t| >= t_r) for Student's t with n - 2 degrees of freedom; null below three rows or without a correlation.

    It is the incomplete beta function I_x((n - 2) / 2, 1 / 2) at x = 1 - r^2, by the continued fraction on the side where that
    converges fast.
    """
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    r, n = r.cast("double"), n.cast("double")
    square = F.least(r * r, F.lit(1.0))
    half = F.lit(0.5)
    a, x = F.greatest((n - 2) / 2, half), 1.0 - square
    lower = x < (a + 1.0) / (a + 2.5)
    p, q, at = F.when(lower, a).otherwise(half), F.when(lower, half).otherwise(a), F.when(lower, x).otherwise(square)
    front = F.exp(a * F.log1p(-square)) * F.sqrt(square) * _gamma_ratio(a) / math.sqrt(math.pi)
    area = front * _beta_fraction(p, q, at) / p
    value = F.when(square >= 1.0, 0.0).when(square <= 0.0, 1.0).when(lower, area).otherwise(1.0 - area)
    return F.when((n >= 3) & r.isNotNull() & ~F.isnan(r), value)
