"""Input checks that look at the schema only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Return ``df``, or raise ``ValueError`` naming the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing column(s): {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def estimated(results: DataFrame) -> DataFrame:
    """The rows of a run that carry an estimate; scores are taken over these, not over failed tickets."""
    return results.filter(F.col("error").isNull()) if "error" in results.columns else results


def require_whole_numbers(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Return ``df``, or raise ``ValueError`` naming the columns that may hold fractions."""
    kinds = dict(df.dtypes)
    wrong = [f"{c} ({kinds[c]})" for c in columns if kinds[c] not in ("tinyint", "smallint", "int", "bigint")]
    if wrong:
        raise ValueError(f"{what} needs whole numbers in column(s): {', '.join(wrong)}")
    return df
