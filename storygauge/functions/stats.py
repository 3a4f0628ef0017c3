"""The one statistic Spark has no function for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


NORMAL_FROM = 100_000  # rows from which the normal limit is used


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 500):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"the continued fraction at a={a}, b={b}, x={x} does not converge")


def two_sided_p(rho: float, n: float) -> float | None:
    """Probability of a rank correlation at least this far from zero, from Student's t with n - 2 degrees."""
    if rho is None or n is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1.0:
        return 0.0
    if n > NORMAL_FROM:  # Wallace's transformation of t to a normal deviate, whose error falls with the square of n
        free = n - 2
        return math.erfc((8 * free + 1) / (8 * free + 3) * math.sqrt(-free * math.log1p(-rho * rho) / 2))
    a, b = (n - 2) / 2.0, 0.5
    x = 1.0 - rho * rho
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)) if rho else 0.0
    if rho == 0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p(r, m) for r, m in zip(rho, n)], dtype="float64")
