"""The regularised incomplete beta function as a column expression, and the p-values that come from it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients for g = 7, nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Above so many degrees of freedom Student's distribution is taken as normal (off by less than 1e-6).
_NORMAL = 500_000


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5."""
    y = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function by Lentz' method."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def turn(s: Column, coefficient: Column) -> Column:
        d, c = 1 / safe(1 + coefficient * s["d"]), safe(1 + coefficient / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def both(s: Column, m: Column) -> Column:
        even = turn(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return turn(even, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, both)["h"]


def beta_inc(a: Column, b: Column, x: Column, terms: int = 1500) -> Column:
    """I_x(a, b) for a, b >= 0.5 and 0 <= x <= 1."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = front * _fraction(a, b, x, terms) / a
    high = 1 - front * _fraction(b, a, 1 - x, terms) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def _normal_tails(z: Column) -> Column:
    """Both tails of the normal distribution beyond z >= 0; a rational approximation, off by at most 1.5e-7."""
    t = 1 / (1 + 0.3275911 * z / math.sqrt(2))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z / 2)


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation of n pairs by Student's t with n - 2 degrees of freedom; null for fewer than three pairs or no correlation at all."""
    df = (n - 2).cast("double")
    rest = 1 - r * r
    exact = beta_inc(df / 2, F.lit(0.5), rest)  # df / (df + t^2) is 1 - r^2
    return F.when((n < 3) | r.isNull() | F.isnan(r), None).when(rest <= 0, 0.0).when(df > _NORMAL, _normal_tails(F.abs(r) * F.sqrt(df / rest))).otherwise(exact)
