"""Tail probabilities without a statistics library, as column expressions.

Both integrate a smooth density by Simpson's rule on a stretch scaled to its width, so that no gamma function is
needed: a Student variable is sqrt(nu) * tan(angle), and its angle's density is proportional to cos(angle)^(nu - 1).
They are meant for result tables of a few rows, and right to five digits or more up to five standard deviations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = 400


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _simpson(low: Column, width: Column, density) -> Column:
    weight = lambda i: F.when((i == 0) | (i == NODES), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(NODES)), F.lit(0.0), lambda s, i: s + weight(i) * density(low + width * i / NODES))
    return total * width / (3.0 * NODES)


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    upper = lambda x: _simpson(x, F.lit(12.0), lambda t: F.exp(-t * t / 2)) / math.sqrt(2 * math.pi)
    return let(z, lambda x: F.when(x >= 0, upper(x)).otherwise(1.0 - upper(-x)))


def chi2_sf(x: Column) -> Column:
    """P(chi-squared with one degree of freedom > x)."""
    return F.when(x <= 0, F.lit(1.0)).otherwise(2.0 * normal_sf(F.sqrt(F.greatest(x, F.lit(0.0)))))


def t_sf(t: Column, nu: Column) -> Column:
    """P(T > t) for Student's distribution with nu degrees of freedom; null if nu is not positive."""

    def body(a: Column) -> Column:
        x, n = F.abs(a["t"]), a["nu"]
        density = lambda angle: F.pow(F.cos(angle), n - 1.0)
        reach = 14.0 / F.sqrt(n)
        start = F.atan(x / F.sqrt(n))
        tail = _simpson(start, F.least(F.lit(math.pi / 2) - start, reach), density)
        half = _simpson(F.lit(0.0), F.least(F.lit(math.pi / 2), reach), density)
        upper = tail / (2.0 * half)
        return F.when(a["t"] >= 0, upper).otherwise(1.0 - upper)

    pair = F.struct(t.cast("double").alias("t"), nu.cast("double").alias("nu"))
    return F.when(t.isNotNull() & (nu > 0), let(pair, body))


def t_quantile(p: float, nu: int) -> float:
    """The p-quantile of Student's distribution, by bisection, for use on the driver."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, nu) < p else (low, mid)
    return (low + high) / 2


def t_cdf(t: float, nu: float) -> float:
    """P(T <= t), the driver's twin of t_sf."""
    n, x = float(nu), abs(t)
    f = lambda angle: math.cos(angle) ** (n - 1.0) if angle < math.pi / 2 else float(n == 1.0)

    def simpson(low: float, width: float) -> float:
        return sum((1 if i in (0, NODES) else 4 if i % 2 else 2) * f(low + width * i / NODES) for i in range(NODES + 1)) * width / (3 * NODES)

    reach, start = 14.0 / math.sqrt(n), math.atan(x / math.sqrt(n))
    upper = simpson(start, min(math.pi / 2 - start, reach)) / (2 * simpson(0.0, min(math.pi / 2, reach)))
    return 1 - upper if t >= 0 else upper


def t_quantile_column(p: float, nu: Column) -> Column:
    """The p-quantile for p > 0.5 by sixty bisections of t_sf's integral; for result tables."""
    target = 1.0 - p
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1000.0).alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        return let(t_sf(mid, nu), lambda q: F.struct(F.when(q > target, mid).otherwise(s["low"]).alias("low"), F.when(q > target, s["high"]).otherwise(mid).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda s: (s["low"] + s["high"]) / 2)
