"""Issue and project tables from JDBC or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storygauge.operators.cleaning import export_view, profile_view


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, lower: int = 0,
    upper: int = 0, partitions: int = 1, **options: str,
) -> DataFrame:
    """A database table; with a numeric ``partition_column`` it is read in parallel ranges.

    Filters and column lists reach the database through Spark's own pushdown.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        if partitions < 1 or upper <= lower:
            raise ValueError("a partitioned read needs lower < upper and at least one partition")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)
        )
    return reader.load()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_issues(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """Issue table for profiling."""
    return profile_view(issues, projects)


def load_issues_for_export(issues: DataFrame, projects: DataFrame, include_zero: bool = False) -> DataFrame:
    """Labelled issue rows for export."""
    return export_view(issues, projects, include_zero)
