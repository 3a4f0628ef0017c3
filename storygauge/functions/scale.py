"""Story-point scale expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from storygauge.schemas import SCALE


def snap_to_scale(value: Column) -> Column:
    """Smallest scale value that is not below ``value``; the top value for anything larger."""
    number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    chain = F.when(number.isNull(), F.lit(None).cast("int"))
    chain = reduce(lambda c, step: c.when(number <= step, F.lit(step)), SCALE, chain)
    return chain.otherwise(F.lit(SCALE[-1]))


def export_label(points: Column) -> Column:
    """Training label: zero stays zero, everything above goes on the scale."""
    return F.when(points == 0, F.lit(0)).otherwise(snap_to_scale(points))


def sample_class(points: Column, include_zero: bool) -> Column:
    """Class used by the balanced sample."""
    return export_label(points) if include_zero else snap_to_scale(points)


def is_on_scale(points: Column) -> Column:
    return F.coalesce(points.isin(*SCALE), F.lit(False))


def round_points(points: Column) -> Column:
    """Half-to-even rounding to a whole number."""
    return F.rint(points)


def is_fractional(points: Column) -> Column:
    return F.coalesce(points != F.rint(points), F.lit(False))


def points_label(points: Column) -> Column:
    """Display form: ``Missing``, a whole number without decimals, or the number itself."""
    number = points.cast("double")
    return (
        F.when(number.isNull() | F.isnan(number), F.lit("Missing"))
        .when(number == F.floor(number), number.cast("decimal(38,0)").cast("string"))
        .otherwise(number.cast("string"))
    )


def confidence_label(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.75, F.lit("High")).when(confidence >= 0.55, F.lit("Medium")).otherwise(F.lit("Low"))
    )
