"""Dataset profile: counts, distributions and text lengths of an issue table.

Each function is one partial-then-final aggregation. Anything that would otherwise meet in one task is first
reduced to its distinct values (labels, lengths), which are few however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from storygauge.functions.scale import is_fractional, points_label, round_points
from storygauge.functions.text import is_blank
from storygauge.operators.cleaning import of_project
from storygauge.session import durable


def one_decimal(value: Column) -> Column:
    return F.rint(value * 10) / 10


def _summary_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_blank(F.col("Title"))).alias("no_title"),
        F.count_if(is_blank(F.col("Description_Text"))).alias("no_text"),
        F.count_if(is_blank(F.col("Priority"))).alias("no_priority"),
    ]


def dataset_summary(issues: DataFrame) -> DataFrame:
    """One row with the core counts of the dataset."""
    return _summary(issues.groupBy("Story_Point").agg(*_summary_counts()))


def _summary(per_label: DataFrame) -> DataFrame:
    def total(c: str | Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return per_label.agg(
        total("n").alias("total"),
        total(F.when(F.col("Story_Point").isNull(), F.col("n"))).alias("missing_story_point"),
        total("no_title").alias("missing_title"),
        total("no_text").alias("missing_description"),
        (total("n") - total("no_priority")).alias("has_priority"),
        total("no_priority").alias("missing_priority"),
        F.count("Story_Point").alias("unique_story_points"),
    )


def missing_fields(issues: DataFrame) -> DataFrame:
    """Missing counts per field with their share of all tickets in percent."""
    summary = dataset_summary(issues)
    rows = summary.select(
        "total",
        F.stack(
            F.lit(4),
            F.lit("Missing Story_Point"), "missing_story_point",
            F.lit("Missing Title"), "missing_title",
            F.lit("Missing Description_Text"), "missing_description",
            F.lit("Missing Priority"), "missing_priority",
        ).alias("metric", "count"),
    )
    share = F.when(F.col("total") > 0, one_decimal(F.col("count") / F.col("total") * 100))
    return rows.select("metric", "count", share.alias("pct"))


def project_summary(issues: DataFrame) -> DataFrame:
    """Tickets and labelled tickets per project, largest first.

    The missing project is named after grouping, so it stays apart from a project really called Unknown.
    """
    return _projects(issues.groupBy("Project_Name").agg(
        F.count(F.lit(1)).alias("n"), F.count("Story_Point").alias("labeled")
    ))


def _projects(per_project: DataFrame) -> DataFrame:
    return per_project.select(
        F.coalesce("Project_Name", F.lit("Unknown")).alias("Project_Name"),
        F.col("n").alias("total_tickets"),
        F.col("labeled").alias("labeled_tickets"),
        one_decimal(F.col("labeled") / F.col("n") * 100).alias("labeled_pct"),
    ).orderBy(F.desc("total_tickets"), "Project_Name", "labeled_tickets")


def top_projects(issues: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` projects with the most labelled tickets."""
    return (
        project_summary(issues)
        .orderBy(F.desc("labeled_tickets"), F.desc("total_tickets"), "Project_Name")
        .limit(n)
    )


def label_counts(issues: DataFrame, points: Column | None = None) -> DataFrame:
    """Counts per label value with its display form; the missing label comes first."""
    value = F.col("Story_Point") if points is None else points
    return _labels(issues.groupBy(value.alias("story_point")).agg(F.count(F.lit(1)).alias("count")))


def _labels(counts: DataFrame) -> DataFrame:
    return counts.withColumn("story_point_label", points_label(F.col("story_point"))).orderBy(
        F.coalesce("story_point", F.lit(-1.0))
    )


def rounded_label_counts(issues: DataFrame) -> DataFrame:
    return label_counts(issues, round_points(F.col("Story_Point")))


def rounded_label_counts_of(issues: DataFrame, project: str) -> DataFrame:
    return rounded_label_counts(of_project(issues, project))


def class_imbalance(issues: DataFrame) -> DataFrame:
    """Share of each label value in percent, two decimals."""
    counts = label_counts(issues)
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(
        "story_point_label", "count", (F.rint(F.col("count") / total * 100 * 100) / 100).alias("pct")
    )


def clean_label_distribution(tickets: DataFrame, label: str = "actual_story_points") -> DataFrame:
    return tickets.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(F.asc_nulls_last(label))


def priority_counts(issues: DataFrame) -> DataFrame:
    """Tickets per priority, most frequent first; the missing one is named after grouping."""
    return _priorities(issues.groupBy("Priority").agg(F.count(F.lit(1)).alias("n")))


def _priorities(counts: DataFrame) -> DataFrame:
    return counts.select(F.coalesce("Priority", F.lit("Missing")).alias("priority"), F.col("n").alias("count")).orderBy(
        F.desc("count"), "priority"
    )


def length_counts(issues: DataFrame, text: str = "Description_Text") -> DataFrame:
    """How many texts have each length: the small table behind the two reports below."""
    return (
        issues.filter(F.col(text).isNotNull())
        .groupBy(F.length(text).alias("length"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_lengths(issues: DataFrame, text: str = "Description_Text") -> DataFrame:
    """Count, mean, sample deviation, extremes and linear quartiles of the text length, one row.

    Sums run exactly, in decimals over the distinct lengths, so the deviation does not depend on row order.
    """
    return _describe(length_counts(issues, text))


def _describe(lengths: DataFrame) -> DataFrame:
    n, length = F.col("n").cast("decimal(38,0)"), F.col("length").cast("decimal(38,0)")
    sums = lengths.agg(
        F.sum("n").alias("count"),
        F.sum(n * length).alias("s1"),
        F.sum(n * length * length).alias("s2"),
        F.min("length").alias("min"),
        F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"),
        F.max("length").alias("max"),
    )
    count = F.col("count").cast("double")
    mean = F.col("s1").cast("double") / count
    spread = F.col("s2") * F.col("count").cast("decimal(38,0)") - F.col("s1") * F.col("s1")
    variance = F.when(F.col("count") > 1, spread.cast("double") / (count * (count - 1)))
    return sums.select(
        F.coalesce("count", F.lit(0)).alias("count"),
        mean.alias("mean"),
        F.sqrt(variance).alias("std"),
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        "max",
    )


def length_histogram(issues: DataFrame, text: str = "Description_Text", bins: int = 50) -> DataFrame:
    """Equal-width histogram of the text length; the top edge belongs to the last bin, empty bins are kept."""
    lengths = length_counts(issues, text)
    span = lengths.agg(F.struct(F.min("length").alias("lo"), F.max("length").alias("hi"))).scalar()
    ranged = lengths.select("length", "n", span["lo"].alias("lo"), span["hi"].alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.when(width > 0, F.floor((F.col("length") - F.col("lo")) / width) + 1).otherwise(F.lit(1))
    filled = ranged.groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin"), "lo", "hi").agg(
        F.sum("n").alias("n")
    )
    per_bin = filled.groupBy("lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    edge = lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return per_bin.select("lo", "hi", "m", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select(
        "bin",
        edge(F.col("bin") - 1).alias("lower"),
        edge(F.col("bin")).alias("upper"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("count"),
    )


def fractional_label_stats(issues: DataFrame) -> DataFrame:
    """Fractional labels, distinct raw labels and distinct rounded labels, one row."""
    points = F.col("Story_Point")
    per_value = issues.groupBy("Story_Point").agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(
        F.coalesce(F.sum(F.when(is_fractional(points), F.col("n"))), F.lit(0)).alias("fractional_story_points"),
        F.count("Story_Point").alias("unique_raw"),
        F.count_distinct(round_points(points)).alias("unique_rounded"),
    )


def profile_tables(issues: DataFrame) -> dict[str, DataFrame]:
    """Summary, text lengths, priorities, labels and projects from a single scan of the issues.

    The rows are counted by label, by priority, by project and by text length at once. The counts, few next to
    the rows, are staged; each table is taken from its share of them.
    """
    keys = ["Story_Point", "Priority", "Project_Name", "length"]
    narrow = issues.select(
        *keys[:3], F.length("Description_Text").alias("length"),
        *[is_blank(F.col(c)).alias(f"_{c}") for c in ("Title", "Description_Text", "Priority")],
        F.col("Story_Point").isNotNull().alias("_labelled"),
    )
    counts = durable(
        narrow.groupingSets([[F.col(k)] for k in keys], *keys).agg(
            F.grouping_id(*keys).alias("_set"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("_Title")).alias("no_title"),
            F.count_if(F.col("_Description_Text")).alias("no_text"),
            F.count_if(F.col("_Priority")).alias("no_priority"),
            F.count_if(F.col("_labelled")).alias("labeled"),
        )
    )
    by = {k: counts.filter(F.col("_set") == 15 - (8 >> i)) for i, k in enumerate(keys)}
    return {
        "summary": _summary(by["Story_Point"]),
        "description_length": _describe(by["length"].filter(F.col("length").isNotNull()).select("length", "n")),
        "priority": _priorities(by["Priority"]),
        "story_point": _labels(by["Story_Point"].select(F.col("Story_Point").alias("story_point"), F.col("n").alias("count"))),
        "project": _projects(by["Project_Name"]),
    }
