"""Upper tails of the distributions behind the tests, for the handful of rows a test produces."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_PI = 1.7724538509055159


def _erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: series for small z, continued fraction above."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)), F.struct(z.alias("power"), z.alias("total")),
        lambda s, k: F.struct(
            (-s["power"] * z * z / k).alias("power"),
            (s["total"] + (-s["power"] * z * z / k) / (k * 2 + 1)).alias("total")),
        lambda s: s["total"])
    fraction = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda tail, k: z + (k / 2) / tail)
    return F.when(z < 2, 1 - series * 2 / ROOT_PI).otherwise(F.exp(-z * z) / (fraction * ROOT_PI))


def chi2_tail(x: Column, df: int) -> Column:
    """P(chi-square with ``df`` degrees of freedom > x), by the finite sums for even and odd df."""
    half = x / 2
    if df % 2 == 0:
        terms = [F.pow(half, F.lit(j)) / math.factorial(j) for j in range(df // 2)]
        tail = F.exp(-half) * sum(terms[1:], terms[0])
    else:
        terms = [F.pow(half, F.lit(j - 0.5)) / math.gamma(j + 0.5) for j in range(1, (df + 1) // 2)]
        tail = _erfc(F.sqrt(half))
        if terms:
            tail = tail + F.exp(-half) * sum(terms[1:], terms[0])
    return F.when(x <= 0, F.lit(1.0)).when(x > 0, tail)


RANGE_STEPS = 2000  # of the quadrature, an even number
RANGE_FROM = -8.0  # where it starts; it ends as far above the width


def studentized_range_tail(width: Column, k: Column) -> Column:
    """P(range of k standard normals > width): the studentised range with infinite freedom.

    The chance of a range up to w is the integral of k phi(z) (Phi(z) - Phi(z - w))^(k - 1). The walk over z
    carries the difference, whose slope is phi(z) - phi(z - w), and the sum, both by Simpson's rule.
    """
    step = (width - 2 * RANGE_FROM) / RANGE_STEPS

    def density(z: Column) -> Column:
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def slope(z: Column) -> Column:
        return density(z) - density(z - width)

    def on(state: Column, i: Column) -> Column:
        z = i * step + RANGE_FROM
        weight = F.when((i == 0) | (i == RANGE_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        area = state["area"] + weight * density(z) * F.pow(F.greatest(state["inside"], F.lit(0.0)), k - 1)
        inside = state["inside"] + (slope(z) + slope(z + step / 2) * 4 + slope(z + step)) * step / 6
        return F.struct(inside.alias("inside"), area.alias("area"))

    start = F.struct(F.lit(0.0).alias("inside"), F.lit(0.0).alias("area"))
    area = F.aggregate(F.sequence(F.lit(0), F.lit(RANGE_STEPS)), start, on, lambda s: s["area"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - k * area * step / 3))
