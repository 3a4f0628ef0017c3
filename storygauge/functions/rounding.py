"""Rounding that decides on the exact binary value of a double, ties to even.

Spark's own ``round`` and ``format_string`` decide on the shortest decimal that prints the double: 0.565 rounds up
there although the stored number is a little below the half. Confidences and similarities follow the stored number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_exact(value: Column, places: int) -> Column:
    """``value`` to ``places`` decimals.

    The distance to the half-way point is formed without rounding error: the value is split into its single-precision
    part and the rest, so each product with the power of ten fits a double.
    """
    power = F.lit(float(10**places))
    x = value.cast("double")
    coarse = x.cast("float").cast("double")
    below = F.floor(x * power).cast("double")
    above_half = (coarse * power - (below + 0.5)) + (x - coarse) * power
    even = below + F.pmod(below, F.lit(2.0))
    return F.when(above_half > 0, below + 1).when(above_half < 0, below).otherwise(even) / power


def fixed(value: Column, places: int) -> Column:
    """Text of ``value`` with exactly ``places`` decimals."""
    rounded = round_exact(value, places)
    sign = F.when((value < 0) & (rounded == 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.format_string(f"%.{places}f", rounded))
