"""Quantiles of the beta distribution as Spark columns.

The distribution function is evaluated by the continued fraction of the incomplete beta
function, from its end, with a number of terms that grows with the root of a + b; the
quantile is found by halving an interval around it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALVINGS = 24


def log_gamma(x: Column) -> Column:
    """For x > 0, by Stirling's series at x + 8."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5)))
    rising = x
    for i in range(1, 8):
        rising = rising * (x + float(i))
    return series - F.log(rising)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def _lower(x: Column, a: Column, b: Column, log_b: Column) -> Column:
    """The distribution function where x is at most (a + 1) / (a + b + 2)."""

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    terms = F.sequence((40 + 4 * F.sqrt(a + b)).cast("int"), F.lit(1), F.lit(-1))
    fraction = F.aggregate(terms, F.lit(1.0), lambda t, k: 1.0 + term(k) / t)
    return F.exp(a * F.log(x) + b * F.log(1 - x) - log_b) / a / fraction


def distribution(x: Column, a: Column, b: Column, log_b: Column) -> Column:
    """Probability of at most x, for 0 < x < 1."""
    return F.when(x < (a + 1) / (a + b + 2), _lower(x, a, b, log_b)).otherwise(1.0 - _lower(1 - x, b, a, log_b))


def quantile(p: float, a: Column, b: Column, log_b: Column) -> Column:
    """x whose ``distribution`` is p; halved ``HALVINGS`` times from ten deviations around the mean."""
    mean = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    low, high = F.greatest(F.lit(0.0), mean - 10 * deviation), F.least(F.lit(1.0), mean + 10 * deviation)

    def halve(s: Column, _: Column) -> Column:
        x = (s["low"] + s["high"]) / 2
        below = distribution(x, a, b, log_b) < p
        return F.struct(F.when(below, x).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(x).alias("high"))

    start = F.struct(low.alias("low"), high.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
