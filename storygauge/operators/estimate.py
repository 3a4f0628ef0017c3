"""Story-point estimates: from neighbours, from keywords, and from generated replies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from storygauge.functions.neighbours import neighbours_json
from storygauge.functions.prompts import NO_RETRIEVAL_WARNING
from storygauge.functions.replies import (
    flag_field, json_object, number_field, subtasks_of, text_field, unreadable, whole_field,
)
from storygauge.functions.rounding import round_exact
from storygauge.functions.scale import is_on_scale, snap_to_scale
from storygauge.functions.text import word_count
from storygauge.operators.neighbours import ranked_list
from storygauge.schemas import COMPLEX_POINTS, NO_RETRIEVAL_CONFIDENCE_CAP, RESULTS

# --- fixed values: the keyword estimator ----------------------------------------------------------
LARGE_WORDS = (
    "rewrite", "migrate", "real-time", "collaborative", "redesign", "architecture", "platform",
    "framework", "overhaul",
)
MEDIUM_WORDS = ("implement", "add", "integrate", "support", "module", "feature", "api")
SMALL_WORDS = ("fix", "typo", "rename", "update text", "log", "tweak")
STANDARD_SUBTASKS = (
    ("Design and spike", 3, "Investigate approach and risks."),
    ("Core implementation", 8, "Build the primary functionality."),
    ("Tests and rollout", 3, "Cover edge cases and ship safely."),
)
KEYWORD_REASONING = (
    "Heuristic signal: ~%d words in the description, keyword profile suggests a %d-point scope. "
    "Configure an API key for a richer LLM-driven explanation."
)
# ------------------------------------------------------------------------------------------------
SUBTASK_ARRAY = "array<struct<title string, story_points int, reasoning string>>"


def neighbour_confidence(top_similarity: Column, spread: Column) -> Column:
    """0.3 to 0.9: higher for a close nearest neighbour, lower when the neighbours' points disagree."""
    closeness = F.least(top_similarity / F.lit(0.85), F.lit(1.0)) * 0.6
    penalty = F.least(spread / F.lit(13.0), F.lit(0.5))
    return round_exact(F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.lit(0.3) + closeness - penalty)), 2)


def neighbour_spread(neighbours: DataFrame) -> DataFrame:
    """Closest similarity and range of points of each query's neighbours."""
    return neighbours.groupBy("query_key").agg(
        F.max("similarity").alias("top_similarity"),
        (F.max("story_points") - F.min("story_points")).alias("points_spread"),
    )


def similar_enough(neighbours: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """Neighbours at or above the threshold; a query without any such neighbour keeps all of its own."""
    close = F.col("similarity") >= F.lit(float(min_similarity))
    any_close = F.max(close).over(Window.partitionBy("query_key"))  # at most fifty rows per query
    return neighbours.withColumn("_any", any_close).filter(close | ~F.col("_any")).drop("_any")


def estimate_from_neighbours(
    neighbours: DataFrame, min_similarity: float = 0.0, listed: Sequence[str] = ()
) -> DataFrame:
    """Points, raw weighted mean and confidence per query, in one aggregation.

    With ``listed``, those columns of the neighbours come along as the list ``similar_tickets``. Every measure is taken twice, over the close neighbours and over all, and the query picks the first if it
    has a close neighbour; so the fallback needs no second pass over the neighbours.
    """
    close = F.col("similarity") >= F.lit(float(min_similarity))
    sp, sim = F.col("story_points").cast("double"), F.col("similarity")

    def measures(keep: Column, tag: str) -> list[Column]:
        only = lambda c: F.when(keep, c)
        return [
            F.count_if(keep).alias(f"n_{tag}"),
            F.sum(only(sp * sim)).alias(f"weighted_{tag}"),
            F.sum(only(sim)).alias(f"weights_{tag}"),
            F.min_by(only(sp), F.when(keep, F.col("rank"))).alias(f"nearest_{tag}"),
            F.max(only(sim)).alias(f"top_{tag}"),
            F.max(only(sp)).alias(f"high_{tag}"),
            F.min(only(sp)).alias(f"low_{tag}"),
        ]

    grouped = neighbours.groupBy("query_key").agg(
        F.count(F.lit(1)).alias("n_neighbours"), *measures(close, "close"), *measures(F.lit(True), "all"),
        *([ranked_list(listed).alias("similar_tickets")] if listed else []),
    )
    carried = ["similar_tickets"] if listed else []
    pick = lambda name: F.when(F.col("n_close") > 0, F.col(f"{name}_close")).otherwise(F.col(f"{name}_all"))
    measured = grouped.select(
        "query_key", "n_neighbours", *carried,
        *[pick(m).alias(m) for m in ("weighted", "weights", "nearest", "top", "high", "low")],
    )
    raw = F.when(F.col("weights") > 0, F.col("weighted") / F.col("weights")).otherwise(F.col("nearest"))
    return measured.withColumn("raw", raw).select(
        "query_key",
        "n_neighbours",
        snap_to_scale(F.round("raw", 9)).alias("rag_story_points"),
        F.col("raw").alias("rag_raw_average"),
        neighbour_confidence(F.col("top"), F.col("high") - F.col("low")).alias("rag_confidence"),
        *carried,
    )


def mentions_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _keyword_points(text: Column) -> Column:
    """The points that the keywords of a lower-case text add."""
    points_of = lambda keywords, n: F.when(mentions_any(text, keywords), n).otherwise(0)
    return points_of(LARGE_WORDS, 6) + points_of(MEDIUM_WORDS, 2) - points_of(SMALL_WORDS, 2)


def estimate_from_keywords(tickets: DataFrame) -> DataFrame:
    """Tickets with the keyword estimate; no neighbours and no generator are needed."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    words, points = F.col("_words"), F.col("story_points")
    score = F.least(F.floor(words / 25), F.lit(6)) + F.col("_keyword_points")
    standard = F.array(*[
        F.struct(F.lit(t).alias("title"), F.lit(p).alias("story_points"), F.lit(r).alias("reasoning"))
        for t, p, r in STANDARD_SUBTASKS
    ])
    return (
        tickets.withColumn("_text", text)  # a projection of its own: the text is made once, however often it is looked at
        .withColumns({"_words": word_count(F.col("_text")), "_keyword_points": _keyword_points(F.col("_text"))})
        .withColumn("story_points", snap_to_scale(F.greatest(F.lit(1), score)))
        .withColumn("confidence", round_exact(F.lit(0.55) + F.least(F.lit(0.25), words / 400), 2))
        .withColumn("complex", points >= COMPLEX_POINTS)
        .withColumn("reasoning", F.format_string(KEYWORD_REASONING, words, points))
        .withColumn("subtasks", F.when(F.col("complex"), standard).otherwise(F.array().cast(SUBTASK_ARRAY)))
        .withColumn("source", F.lit("heuristic"))
        .drop("_text", "_words", "_keyword_points")
    )


def merge_replies(replied: DataFrame, model: str) -> DataFrame:
    """Estimates from replies, with or without neighbours, one row per ticket.

    ``replied`` has the ticket columns, the neighbour estimate (NULL without neighbours), ``similar_tickets``,
    ``reply`` and ``error``, and, straight from the generator, the ``payload`` read from the reply. With neighbours the
    points are theirs and the reply only explains; without, the points come from the reply and the confidence is capped.
    A failed call, a reply without a JSON object and one whose numbers cannot be read give an ``error``; every estimate
    column of such a row is NULL.
    """
    payload, subtasks = F.col("_payload"), F.col("_subtasks")
    grounded = F.col("rag_story_points").isNotNull()
    said, stated = F.col("_said"), F.col("_stated")
    own_points = F.when(is_on_scale(said), said).otherwise(snap_to_scale(said))
    reasoning = text_field(payload, "reasoning")
    warned = F.when(reasoning.startswith(NO_RETRIEVAL_WARNING), reasoning).otherwise(
        F.concat(F.lit(NO_RETRIEVAL_WARNING), F.lit(" "), reasoning)
    )
    wrong = lambda condition, message: F.when(condition, F.lit(message))
    failed = F.coalesce(
        "error",
        wrong(payload.isNull(), "no JSON object in the reply"),
        wrong(~grounded & unreadable(payload, "story_points", said), "story_points is no whole number"),
        wrong(unreadable(payload, "confidence", stated), "confidence is no number"),
        wrong(F.exists(subtasks, lambda s: s["story_points"].isNull()), "story_points of a subtask is no whole number"),
    )
    text = F.try_parse_json("payload") if "payload" in replied.columns else json_object(F.col("reply"))
    read = (
        replied.withColumn("_payload", text)
        .withColumn("_said", whole_field(payload, "story_points", 3))
        .withColumn("_stated", number_field(payload, "confidence"))
        .withColumn("_subtasks", subtasks_of(payload))
        .withColumn("error", failed)
    )
    fine = lambda value: F.when(F.col("error").isNull(), value)
    points = fine(F.when(grounded, F.col("rag_story_points")).otherwise(own_points))
    return (
        read.withColumn("story_points", points)
        .withColumn(
            "confidence",
            fine(F.when(grounded, F.least(F.coalesce(stated, F.col("rag_confidence")), F.col("rag_confidence")))
                 .otherwise(F.least(F.coalesce(stated, F.lit(0.4)), F.lit(NO_RETRIEVAL_CONFIDENCE_CAP)))),
        )
        .withColumn("reasoning", fine(F.when(grounded, reasoning).otherwise(warned)))
        .withColumn("complex", fine(F.coalesce(flag_field(payload, "complex"), F.col("story_points") >= COMPLEX_POINTS)))
        .withColumn("subtasks", fine(subtasks))
        .withColumn(
            "source",
            fine(F.when(grounded, F.lit(f"rag+llm:{model}")).otherwise(F.lit(f"llm:{model}+no-retrieval"))),
        )
        .withColumn("no_rag_fallback", fine(~grounded))
        .withColumn("rag_story_points", fine(F.col("rag_story_points")))
        .withColumn("rag_raw_average", fine(round_exact(F.col("rag_raw_average"), 2)))
        .withColumn("rag_confidence", fine(F.col("rag_confidence")))
        .drop("_payload", "_said", "_stated", "_subtasks", "payload")
    )


def subtask_columns(subtasks: Column) -> dict[str, Column]:
    """Count, point sum, joined titles and JSON text of a subtask list."""
    titles = F.transform(subtasks, lambda s: s["title"])
    return {
        "subtask_count": F.size(subtasks),
        "subtask_points_sum": F.aggregate(
            subtasks, F.lit(0).cast("long"), lambda total, s: total + s["story_points"], lambda total: total.try_cast("int")
        ),
        "subtask_titles": F.array_join(titles, " | "),
        "subtasks_json": F.to_json(subtasks),
    }


def to_results(estimates: DataFrame) -> DataFrame:
    """The results table, with the failed tickets marked in ``error``."""
    flat = estimates.withColumns(subtask_columns(F.col("subtasks"))).withColumns({
        "predicted_story_points": F.col("story_points"),
        "complex_flag": F.col("complex"),
        "similar_tickets_json": neighbours_json(F.col("similar_tickets")),
    })
    return flat.select(*RESULTS.fieldNames(), "error")


def run_outcome(results: DataFrame) -> DataFrame:
    """How many tickets were estimated and how many failed, one row."""
    return results.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("error").isNull()).alias("written"),
        F.count("error").alias("failed"),
    )


def failures(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNotNull()).select("issue_key", "error")
