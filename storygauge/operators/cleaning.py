"""From raw issue rows to clean, labelled tickets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from storygauge.functions.scale import export_label
from storygauge.functions.text import (
    is_blank, key_or_default, name_or_default, pick_description, strip, unquote,
)
from storygauge.schemas import MAX_STORY_POINT

PROFILE_COLUMNS = (
    "Story_Point", "Title", "Description", "Description_Text", "Priority", "Project_ID", "Project_Name",
)
EXPORT_COLUMNS = (
    "ID", "Issue_Key", "Project_Name", "Type", "Title", "Description", "Description_Text", "Story_Point",
)


def with_project(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """Issues with the name of their project; NULL where the project is unknown.

    No hint: the planner broadcasts the projects while they are below its size threshold, and beyond it
    adaptive execution splits the partitions of a project that holds much of the issue table.
    """
    names = projects.select(F.col("ID").alias("_project_id"), F.col("Name").alias("Project_Name"))
    return issues.join(names, issues["Project_ID"] == names["_project_id"], "left").drop("_project_id")


def profile_view(issues: DataFrame, projects: DataFrame) -> DataFrame:
    return with_project(issues, projects).select(*PROFILE_COLUMNS)


def labelled(points: Column, include_zero: bool) -> Column:
    """Condition on a usable label: present and within range; zero only on request."""
    in_range = points.between(0, MAX_STORY_POINT)
    return in_range if include_zero else in_range & (points > 0)


def export_view(issues: DataFrame, projects: DataFrame, include_zero: bool = False) -> DataFrame:
    kept = issues.filter(labelled(F.col("Story_Point"), include_zero))
    return with_project(kept, projects).select(*EXPORT_COLUMNS)


def to_tickets(issues: DataFrame, key_prefix: str = "ISSUE-") -> DataFrame:
    """Clean ticket records of labelled issue rows; rows with a negative label are left out."""
    points = F.col("Story_Point")
    return issues.filter(points >= 0).select(
        key_or_default(F.col("Issue_Key"), F.col("ID"), key_prefix).alias("issue_key"),
        name_or_default(F.col("Project_Name")).alias("project"),
        F.coalesce("Type", F.lit("")).alias("issue_type"),
        unquote(F.col("Title")).alias("title"),
        pick_description(F.col("Description_Text"), F.col("Description")).alias("description"),
        export_label(points).alias("actual_story_points"),
    )


def eligible_pool(tickets: DataFrame) -> DataFrame:
    """Tickets with a description and a numeric label of at least zero; the description comes out stripped."""
    label = F.col("actual_story_points").try_cast("double")
    return (
        tickets.withColumn("description", strip(F.col("description")))
        .withColumn("actual_story_points", label)
        .filter((F.col("description") != "") & (label >= 0) & ~F.isnan(label))
        .withColumn("actual_story_points", F.col("actual_story_points").cast("int"))
    )


def of_project(issues: DataFrame, project: str) -> DataFrame:
    return issues.filter(F.col("Project_Name") == project)


def with_key(df: DataFrame, key: str = "issue_key") -> DataFrame:
    """Rows whose key is not blank."""
    return df.filter(~is_blank(F.col(key)))


def mark_valid_submissions(df: DataFrame, required: tuple[str, ...] = ("title", "project", "description")) -> DataFrame:
    """Submissions with ``valid``: true when every required field has text."""
    return df.withColumn("valid", reduce(lambda a, b: a & b, [~is_blank(F.col(c)) for c in required]))


def split_submissions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected submissions."""
    marked = mark_valid_submissions(df)
    return marked.filter("valid").drop("valid"), marked.filter("not valid").drop("valid")
