"""Review sheets for people, and the scores of filled sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from storygauge.functions.neighbours import (
    has_neighbours, neighbour_line, parse_neighbours, parse_subtasks, retrieved_keys,
)
from storygauge.functions.replies import agrees_with_points
from storygauge.functions.text import issue_keys_in, leading_snippet, strip
from storygauge.operators.checks import require_columns
from storygauge.schemas import HALLUCINATION_LABELS, RUBRIC_COLUMNS


def justification_sheet(results: DataFrame) -> DataFrame:
    """One row per result with neighbours, its rubric columns left blank."""
    items = F.col("_items")
    with_items = results.withColumn("_items", parse_neighbours(F.col("similar_tickets_json")))
    return with_items.filter(has_neighbours(items)).select(
        "issue_key",
        F.col("title").alias("ticket_title"),
        leading_snippet(F.col("description")).alias("ticket_description_snippet"),
        "predicted_story_points",
        "reasoning",
        neighbour_line(items).alias("neighbour_keys"),
        "similar_tickets_json",
        *[F.lit("").alias(c) for c in RUBRIC_COLUMNS],
    )


def subtask_sheet(results: DataFrame) -> DataFrame:
    """One row per generated subtask, its label left blank."""
    return results.select(
        "issue_key",
        F.col("title").alias("ticket_title"),
        F.col("description").alias("ticket_description"),
        F.explode(parse_subtasks(F.col("subtasks_json"))).alias("s"),
    ).select(
        "issue_key", "ticket_title", "ticket_description",
        F.col("s.title").alias("subtask_title"), F.col("s.reasoning").alias("subtask_reasoning"),
        F.lit("").alias("label"),
    )


def citation_checks(sheet: DataFrame) -> DataFrame:
    """Per row: keys cited, keys retrieved, and the three automatic verdicts."""
    text = sheet["neighbour_keys"] if "neighbour_keys" in sheet.columns else F.lit("")
    items = (
        parse_neighbours(sheet["similar_tickets_json"]) if "similar_tickets_json" in sheet.columns
        else parse_neighbours(F.lit("[]"))
    )
    cited, retrieved = F.col("cited"), F.col("retrieved")
    return sheet.select(
        "issue_key",
        issue_keys_in(sheet["reasoning"]).alias("cited"),
        retrieved_keys(items, text).alias("retrieved"),
        agrees_with_points(sheet["reasoning"], sheet["predicted_story_points"]).alias("consistent"),
    ).withColumns({
        "has_neighbours": F.size(retrieved) > 0,
        "cites_neighbour": F.arrays_overlap(cited, retrieved),
        "invented": F.array_except(cited, retrieved),
    })


def automatic_checks(sheet: DataFrame) -> DataFrame:
    """Shares of rows that cite a neighbour, invent no key, and keep to the fixed points; one row."""
    some = F.col("has_neighbours")
    n, eligible = F.count(F.lit(1)), F.count_if(some)
    share = lambda cond: F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))
    return citation_checks(sheet).agg(
        n.alias("n"),
        F.avg(F.when(some, F.col("cites_neighbour").cast("double"))).alias("pct_cites_neighbour"),
        eligible.alias("n_eligible_cite"),
        share(F.size("invented") == 0).alias("pct_no_invented_keys"),
        share(F.col("consistent")).alias("pct_sp_consistent"),
    )


def _score(column: str) -> Column:
    """0 or 1 as written on the sheet, also when a spreadsheet made it a decimal; else NULL."""
    text = strip(F.col(column).cast("string"))
    return F.when(text.isin("1", "1.0"), 1).when(text.isin("0", "0.0"), 0)


def fully_labelled(sheet: DataFrame) -> DataFrame:
    """Rows on which every rubric column holds 0 or 1, as integers."""
    require_columns(sheet, RUBRIC_COLUMNS, "review sheet")
    scored = sheet.withColumns({c: _score(c) for c in RUBRIC_COLUMNS})
    return scored.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in RUBRIC_COLUMNS]))


def rubric_rates(sheet: DataFrame) -> DataFrame:
    """Rate and sum per rubric column over the fully labelled rows, with the mean rate and the rows left out."""
    require_columns(sheet, RUBRIC_COLUMNS, "review sheet")
    scored = sheet.select(*[_score(c).alias(c) for c in RUBRIC_COLUMNS])
    done = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in RUBRIC_COLUMNS])
    sums = scored.agg(
        F.count_if(done).alias("labeled"),
        F.count_if(~done).alias("unlabeled"),
        *[F.sum(F.when(done, F.col(c))).alias(c) for c in RUBRIC_COLUMNS],
    )
    mean = reduce(lambda a, b: a + b, [F.col(c) / F.col("labeled") for c in RUBRIC_COLUMNS]) / len(RUBRIC_COLUMNS)
    pairs = [x for c in RUBRIC_COLUMNS for x in (F.lit(c), F.col(c))]
    return sums.filter("labeled > 0").select(
        "labeled", "unlabeled", mean.alias("mean_rate"), F.stack(F.lit(len(RUBRIC_COLUMNS)), *pairs).alias("rubric", "positive")
    ).select("rubric", "positive", "labeled", "unlabeled", (F.col("positive") / F.col("labeled")).alias("rate"), "mean_rate")


def with_valid_label(sheet: DataFrame) -> DataFrame:
    return sheet.filter(F.col("label").isin(*HALLUCINATION_LABELS))


def label_rates(sheet: DataFrame) -> DataFrame:
    """Count and share of each of the three labels among labelled subtasks; a label never used counts zero."""
    counts = sheet.agg(*[F.count_if(F.col("label") == l).alias(l) for l in HALLUCINATION_LABELS])
    total = reduce(lambda a, b: a + b, [F.col(l) for l in HALLUCINATION_LABELS])
    pairs = [x for l in HALLUCINATION_LABELS for x in (F.lit(l), F.col(l))]
    return counts.select(total.alias("total"), F.stack(F.lit(3), *pairs).alias("label", "n")).select(
        "label", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).alias("share")
    )


def hallucination_summary(sheet: DataFrame) -> DataFrame:
    """Labelled and unlabelled subtasks, hallucination rate, and tickets with a hallucinated subtask; one row."""
    valid = F.coalesce(F.col("label").isin(*HALLUCINATION_LABELS), F.lit(False))
    per_ticket = sheet.groupBy("issue_key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(valid).alias("labeled"),
        F.count_if(F.col("label") == "hallucinated").alias("bad"),
    )
    share = lambda part, whole: F.when(whole > 0, part / whole)
    return per_ticket.agg(
        F.coalesce(F.sum("labeled"), F.lit(0)).alias("labeled"),
        F.coalesce(F.sum(F.col("rows") - F.col("labeled")), F.lit(0)).alias("unlabeled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("hallucinated"),
        F.count_if((F.col("labeled") > 0) & F.col("issue_key").isNotNull()).alias("tickets"),
        F.count_if((F.col("bad") > 0) & F.col("issue_key").isNotNull()).alias("tickets_hallucinated"),
    ).withColumns({
        "hallucination_rate": share(F.col("hallucinated"), F.col("labeled")),
        "ticket_rate": share(F.col("tickets_hallucinated"), F.col("tickets")),
    })
