"""Tails of distributions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_gamma_step(a: Column) -> Column:
    """ln gamma(a + 1/2) - ln gamma(a) for a > 0: Stirling's series eight steps up, where it is exact to 1e-15, and back."""
    z = a + 8
    rest = lambda x: 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    high = z * F.log1p(0.5 / z) + 0.5 * F.ln(z) - 0.5 + rest(z + 0.5) - rest(z)
    return high - sum((F.log1p(0.5 / (a + k)) for k in range(8)), F.lit(0.0))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; its terms needed grow with the root of a + b."""
    terms = F.sequence(F.lit(2), (60 + 8 * F.sqrt(a + b)).cast("int"))
    first = 1 / (1 - (a + b) * x / (a + 1))
    m = lambda j: F.floor(j / 2)
    even = lambda j: m(j) * (b - m(j)) * x / ((a + 2 * m(j) - 1) * (a + 2 * m(j)))
    odd = lambda j: -(a + m(j)) * (a + b + m(j)) * x / ((a + 2 * m(j)) * (a + 2 * m(j) + 1))

    def step(acc: Column, j: Column) -> Column:
        k = F.when(j % 2 == 0, even(j)).otherwise(odd(j))
        d, c = 1 / (1 + k * acc["d"]), 1 + k / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(terms, start, step, lambda acc: acc["h"])


def t_tail(t: Column, df: Column) -> Column:
    """The two-sided tail of Student's t with df degrees of freedom, whole or not; null for df <= 0 or null or NaN t."""
    t, df = t.cast("double"), df.cast("double")
    a, b = df / 2, F.lit(0.5)
    ratio = t * t / df
    x, y = 1 / (1 + ratio), ratio / (1 + ratio)
    front = F.exp(-a * F.log1p(ratio) + _log_gamma_step(a) - 0.5 * math.log(math.pi)) * F.sqrt(y)
    tail = F.when(x < (a + 1) / (a + 2.5), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, y) / b)
    tail = F.when(t == 0, 1.0).when(F.abs(t) == math.inf, 0.0).otherwise(tail)
    return F.when((df > 0) & t.isNotNull() & ~F.isnan(t), tail)
