"""Vector expressions on ``array<float>`` columns, evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector scaled to length one; NULL for a zero vector."""
    length = F.nullif(norm(a), F.lit(0.0))
    return F.when(length.isNotNull(), F.transform(a, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector is NULL or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def usable(a: Column) -> Column:
    """True for vectors that have a direction."""
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))
