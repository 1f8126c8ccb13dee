"""Divergences between two answer distributions, as column expressions.

The variants differ on purpose (base of the logarithm, guards, renormalisation) and are named, never merged.  A null or
NaN on either side is a missing answer and makes the divergence null, so that all metrics of a cell count the same cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(*xs: Column) -> Column:
    """Whether all are there: neither null nor NaN."""
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull() & ~F.isnan(x)
    return out


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))
    return F.when(known(p), F.ln(q / (1.0 - q)))


def softmax(z: Column) -> Column:
    """k-way softmax of array<double>, shifted by the largest value."""
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def _term(a: Column, m: Column, log) -> Column:
    """a * log(a / m), 0 where a is 0."""
    return F.when(a > 0, a * log(F.when(a > 0, a / m).otherwise(1.0))).otherwise(0.0)


def jsd_nats(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two array<double> distributions, natural logarithm."""
    half = F.zip_with(p, q, lambda a, b: _term(a, (a + b) / 2, F.ln) / 2 + _term(b, (a + b) / 2, F.ln) / 2)
    return F.aggregate(half, F.lit(0.0), lambda s, v: s + v)


def jsd_bits(p: Column, q: Column, base: float = 2.0) -> Column:
    """Jensen-Shannon divergence of two Bernoulli probabilities; exactly 0 for equal ones.

    Each of p and q is written several times into the expression: give columns, not computations (`probabilities`).
    """
    total = F.lit(0.0)
    log = F.log2 if base == 2.0 else (lambda x: F.log(base, x))
    for a, b in ((p, q), (1.0 - p, 1.0 - q)):
        m = (a + b) / 2
        total = total + _term(a, m, log) / 2 + _term(b, m, log) / 2
    return F.when(known(p, q), F.when(p == q, F.lit(0.0)).otherwise(total))


def probabilities(df: DataFrame, **logits: str) -> DataFrame:
    """Adds a probability column for each name=logit column, to be computed once however often it is used; null for NaN."""
    return df.withColumns({n: F.when(known(F.col(c)), sigmoid(F.col(c))) for n, c in logits.items()})


def _kl(p: Column, q: Column) -> Column:
    return p * F.log2(p / q) + (1.0 - p) * F.log2((1.0 - p) / (1.0 - q))


def kl_bits_clipped(p: Column, q: Column, eps: float = 1e-15) -> Column:
    """KL(p || q) of Bernoulli probabilities, clipped to [eps, 1 - eps] and not renormalised."""
    clip = lambda x: F.greatest(F.least(x, F.lit(1.0 - eps)), F.lit(eps))
    return F.when(known(p, q), _kl(clip(p), clip(q)))


def kl_bits_floored(p: Column, q: Column, floor: float = 1e-10) -> Column:
    """KL(p || q) of Bernoulli probabilities, each part raised to `floor` and then renormalised."""
    up = lambda x: F.greatest(x, F.lit(floor)) / (F.greatest(x, F.lit(floor)) + F.greatest(1.0 - x, F.lit(floor)))
    return F.when(known(p, q), _kl(up(p), up(q)))
