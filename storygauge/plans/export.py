"""Training-data export and the dataset report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from storygauge.operators.cleaning import eligible_pool, export_view, to_tickets
from storygauge.operators.profile import clean_label_distribution, profile_tables
from storygauge.operators.sampling import balanced_sample, mark_split
from storygauge.plans.evaluate import as_rows
from storygauge.sources.files import write_csv


def export_sets(
    issues: DataFrame, projects: DataFrame, fraction: float = 0.2, seed: int = 42,
    identity: Sequence[str] = ("ID",), key_prefix: str = "ISSUE-",
) -> dict[str, DataFrame]:
    """The full clean set and the two balanced samples.

    Nothing is cached: the samples read only the label and the identity of the whole source, and in full only the
    rows they keep pass on.
    """
    positive = export_view(issues, projects)
    with_zero = export_view(issues, projects, include_zero=True)
    return {
        "full": to_tickets(positive, key_prefix),
        "balanced": balanced_sample(positive, fraction, False, seed, identity, key_prefix),
        "balanced_with_zero": balanced_sample(with_zero, fraction, True, seed, identity, key_prefix),
    }


def distributions(sets: dict[str, DataFrame]) -> DataFrame:
    """Label counts of each set."""
    parts = [clean_label_distribution(df).select(F.lit(name).alias("set"), "actual_story_points", "count") for name, df in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def export(issues: DataFrame, projects: DataFrame, out: str, **options) -> dict[str, str]:
    """Write the three sets as CSV directories below ``out``; returns their paths."""
    paths = {}
    for name, df in export_sets(issues, projects, **options).items():
        paths[name] = f"{out}/{name}"
        write_csv(df, paths[name])
    return paths


def split(
    issues: DataFrame, projects: DataFrame, fraction: float = 0.8, seed: int = 42, key_prefix: str = "ISSUE-"
) -> DataFrame:
    """All eligible tickets, each marked as corpus or holdout in ``side``."""
    pool = eligible_pool(to_tickets(export_view(issues, projects, include_zero=True), key_prefix))
    return mark_split(pool, fraction, seed)


def write_split(marked: DataFrame, out: str) -> tuple[str, str]:
    """Both sides as CSV directories, each in key order, in one pass over the tickets."""
    write_csv(marked, out, order_by="issue_key", partition_by="side")
    return f"{out}/side=corpus", f"{out}/side=holdout"


def profile_report(issues: DataFrame) -> DataFrame:
    """Summary, text lengths, priorities, labels and projects as rows of (section, metric, value)."""
    tables = profile_tables(issues)
    return reduce(DataFrame.unionByName, [
        as_rows(tables["summary"], "summary"),
        as_rows(tables["description_length"], "description_length"),
        as_rows(tables["priority"], "priority", F.col("priority")),
        as_rows(tables["story_point"].drop("story_point"), "story_point", F.col("story_point_label")),
        as_rows(tables["project"], "project", F.col("Project_Name")),
    ])
