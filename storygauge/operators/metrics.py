"""Scores of a results table.

Points take few values, so every score first counts the (actual, predicted) pairs, which combines on the map side
and has no hot key, and then works on that small table. Where it is used more than once the small table is staged
in the checkpoint folder, so the results are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from storygauge.functions.neighbours import parse_neighbours, same_stem_share
from storygauge.functions.scale import is_on_scale
from storygauge.functions.stats import correlation_p
from storygauge.operators.checks import estimated, require_columns, require_whole_numbers
from storygauge.schemas import COMPLEX_THRESHOLD
from storygauge.session import durable

POINT_COLUMNS = ("issue_key", "actual_story_points", "predicted_story_points")
RANK_GROUP = 1 << 16


def off_scale(results: DataFrame) -> DataFrame:
    """Predictions that are not on the story-point scale."""
    return estimated(results).filter(~is_on_scale(F.col("predicted_story_points"))).select("issue_key", "predicted_story_points")


def point_pairs(results: DataFrame) -> DataFrame:
    """How often each (actual, predicted) pair occurs among the estimated tickets."""
    require_whole_numbers(results, ("actual_story_points", "predicted_story_points"), "results")
    return estimated(results).groupBy(
        F.col("actual_story_points").alias("actual"), F.col("predicted_story_points").alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))


def run_counts(results: DataFrame) -> DataFrame:
    """How often each (issue_key, actual, predicted) occurs among the estimated tickets of a run.

    Several scores of one run can be taken from it, once it is staged: ``error_scores`` and ``paired_scores``.
    """
    require_columns(results, POINT_COLUMNS, "results")
    require_whole_numbers(results, ("actual_story_points", "predicted_story_points"), "results")
    return estimated(results).groupBy(
        "issue_key", F.col("actual_story_points").alias("actual"), F.col("predicted_story_points").alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(pairs: DataFrame, value: str) -> DataFrame:
    """Tied average rank of each distinct value, from counts.

    Values are whole numbers. They are cut into ranges of 65,536, so a window holds at most that many distinct
    values, and the window over the ranges at most that many ranges.
    """
    counts = pairs.groupBy(F.col(value)).agg(F.sum("n").alias("same"))
    counts = counts.withColumn("_range", F.floor(F.col(value) / RANK_GROUP))
    before = lambda total, w: F.sum(total).over(w) - F.col(total)
    ranges = counts.groupBy("_range").agg(F.sum("same").alias("_total"))
    ranges = ranges.select("_range", before("_total", Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_offset"))
    within = before("same", Window.partitionBy("_range").orderBy(value))
    return (
        counts.withColumn("_within", within)
        .join(ranges, "_range")
        .select(value, (F.col("_offset") + F.col("_within") + (F.col("same") + 1) / 2).alias(f"{value}_rank"))
    )


def rank_correlation(results: DataFrame) -> DataFrame:
    """Spearman's rho of actual and predicted points with its two-sided p, one row."""
    return _rank_correlation(durable(point_pairs(results)))


def _rank_correlation(pairs: DataFrame) -> DataFrame:
    ranked = (
        pairs.join(average_ranks(pairs, "actual"), "actual", "left")
        .join(average_ranks(pairs, "predicted"), "predicted", "left")
    )
    # ranks have the mean (n + 1) / 2 exactly, so a constant column is exactly zero once centred
    middle = (pairs.agg(F.sum("n")).scalar() + 1) / 2
    n, x, y = F.col("n").cast("double"), F.col("actual_rank") - middle, F.col("predicted_rank") - middle
    sums = ranked.agg(
        F.sum(n).alias("n"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"),
        F.count_if(F.col("actual").isNull() | F.col("predicted").isNull()).alias("gaps"),
    )
    vary = (F.col("xx") > 0) & (F.col("yy") > 0)
    rho = F.when((F.col("gaps") == 0) & (F.col("n") > 1) & vary, F.col("xy") / F.sqrt("xx") / F.sqrt("yy"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))
    return sums.select(F.coalesce(F.col("n"), F.lit(0.0)).alias("n"), F.when(rho.isNotNull(), bounded).alias("spearman_rho")).select(
        F.col("n").cast("long").alias("n"), "spearman_rho", correlation_p("spearman_rho", "n").alias("spearman_p")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _plain_errors(pairs: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    error = F.abs(F.col("predicted") - F.col("actual")).cast("double")
    relative = error / F.nullif(F.col("actual"), F.lit(0))
    known = F.sum(F.when(error.isNotNull(), n))
    rows = F.sum(n)
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        _ratio(F.sum(error * n), known).alias("mae"),
        F.sqrt(_ratio(F.sum(error * error * n), known)).alias("rmse"),
        _ratio(F.sum(relative * n), F.sum(F.when(relative.isNotNull(), n))).alias("mmre"),
        _ratio(F.sum(F.when(relative <= 0.25, n).otherwise(0.0)), rows).alias("pred25"),
        _ratio(F.sum(F.when(relative <= 0.50, n).otherwise(0.0)), rows).alias("pred50"),
        _ratio(F.sum(F.when(error == 0, n).otherwise(0.0)), rows).alias("exact_match_rate"),
    )


def error_metrics(results: DataFrame) -> DataFrame:
    """n, MAE, RMSE, MMRE, PRED(25), PRED(50), exact matches, Spearman's rho and p; one row.

    A ticket with zero actual points has no relative error: MMRE leaves it out, and PRED counts it as a miss.
    """
    require_columns(results, POINT_COLUMNS, "results")
    return _scores(durable(point_pairs(results)))


def error_scores(counts: DataFrame) -> DataFrame:
    """``error_metrics`` of a run given by counts of (actual, predicted), with or without further keys."""
    return _scores(durable(counts.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))))


def _scores(pairs: DataFrame) -> DataFrame:
    return _plain_errors(pairs).join(_rank_correlation(pairs), "n")


def worst_misses(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest absolute errors, ties in key order."""
    error = F.abs(F.col("predicted_story_points") - F.col("actual_story_points")).alias("abs_error")
    return (
        estimated(results).select(*POINT_COLUMNS, error).orderBy(F.desc_nulls_last("abs_error"), "issue_key").limit(n)
    )


def paired_errors(rag: DataFrame, norag: DataFrame) -> DataFrame:
    """Tickets of two runs matched on the key: absolute error with and without retrieval.

    Equal errors of one key are counted on each side before the join, and ``n_pairs`` carries the product, so a key
    that occurs often on both sides yields as many rows as it has different errors, not the square of its rows.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        error = F.abs(F.col("predicted_story_points") - F.col("actual_story_points"))
        return estimated(df).groupBy("issue_key", error.alias(f"error_{tag}")).agg(F.count(F.lit(1)).alias(f"_n_{tag}"))

    return _paired(side(rag, "rag"), side(norag, "norag"))


def _paired(rag: DataFrame, norag: DataFrame) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731 - the product may exceed 64 bits
    return (
        rag.join(norag, "issue_key")
        .select("issue_key", "error_rag", "error_norag", (wide("_n_rag") * wide("_n_norag")).alias("n_pairs"))
    )


def paired_comparison(rag: DataFrame, norag: DataFrame) -> DataFrame:
    """Pairs, mean error difference (negative favours retrieval) and share of pairs closer with it; one row."""
    return _comparison(paired_errors(rag, norag))


def error_counts(counts: DataFrame, tag: str) -> DataFrame:
    """How often each absolute error of a key occurs in a run given by ``run_counts``."""
    error = F.abs(F.col("predicted") - F.col("actual"))
    return counts.groupBy("issue_key", error.alias(f"error_{tag}")).agg(F.sum("n").alias(f"_n_{tag}"))


def paired_scores(rag: DataFrame, norag: DataFrame) -> DataFrame:
    """``paired_comparison`` of two runs given by ``run_counts``."""
    return _comparison(_paired(error_counts(rag, "rag"), error_counts(norag, "norag")))


def paired_sums(rag: DataFrame, norag: DataFrame) -> DataFrame:
    """What ``paired_scores`` is worked out from, one row; rows of several parts of the pairs add up."""
    return _comparison_sums(_paired(error_counts(rag, "rag"), error_counts(norag, "norag")))


def _comparison(pairs: DataFrame) -> DataFrame:
    return comparison_of(_comparison_sums(pairs))


def _comparison_sums(pairs: DataFrame) -> DataFrame:
    n = F.col("n_pairs").cast("double")
    delta = (F.col("error_rag") - F.col("error_norag")).cast("double")
    return pairs.agg(
        F.coalesce(F.sum(F.col("n_pairs").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("n_pairs"),
        F.sum(delta * n).alias("delta_sum"), F.sum(F.when(delta.isNotNull(), n)).alias("known"),
        F.sum(F.when(delta < 0, n).otherwise(0.0)).alias("closer"), F.sum(n).alias("all_pairs"),
    )


def comparison_of(sums: DataFrame) -> DataFrame:
    """``paired_comparison`` from one or more rows of sums."""
    return sums.agg(
        F.coalesce(F.sum("n_pairs"), F.lit(0)).try_cast("long").alias("n_paired"),
        _ratio(F.sum("delta_sum"), F.sum("known")).alias("mean_abs_error_delta"),
        _ratio(F.sum("closer"), F.sum("all_pairs")).alias("pct_rag_closer"),
    )


RETRIEVAL_VALUES = {
    "top1": "mean_top1_similarity", "topk": "mean_topk_similarity", "spread": "mean_neighbour_sp_spread", "stem": "mean_same_project_rate",
}


def retrieval_sums(results: DataFrame) -> DataFrame:
    """What ``retrieval_stats`` is worked out from, one row; rows of several parts of the results add up."""
    items = F.col("_items")
    sims = F.transform(items, lambda t: F.coalesce(t["similarity"], F.lit(0.0)))
    points = F.transform(items, lambda t: F.coalesce(t["story_points"], F.lit(0)))
    some = F.size(items) > 0
    total = F.aggregate(sims, F.lit(0.0), lambda a, b: a + b)
    per_row = estimated(results).select("issue_key", parse_neighbours(F.col("similar_tickets_json")).alias("_items")).select(
        some.alias("some"),
        F.when(some, F.array_max(sims)).alias("top1"),
        F.when(some, total / F.size(items)).alias("topk"),
        F.when(some, (F.array_max(points) - F.array_min(points)).cast("double")).alias("spread"),
        same_stem_share(F.col("issue_key"), items).alias("stem"),
    )
    values = [x for c in RETRIEVAL_VALUES for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
    return per_row.agg(F.count(F.lit(1)).alias("n"), F.count_if("some").alias("some"), *values)


def retrieval_of(sums: DataFrame) -> DataFrame:
    """``retrieval_stats`` from one or more rows of sums."""
    n = F.sum("n")
    means = [_ratio(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(name) for c, name in RETRIEVAL_VALUES.items()]
    with_some = F.coalesce(_ratio(F.sum("some").cast("double"), n), F.lit(0.0))
    return sums.agg(F.coalesce(n, F.lit(0)).alias("n"), with_some.alias("pct_with_neighbours"), *means)


def retrieval_stats(results: DataFrame) -> DataFrame:
    """How useful the neighbours were: coverage, similarities, spread of points, same-project share; one row."""
    return retrieval_of(retrieval_sums(results))


def confidence_band_sums(results: DataFrame) -> DataFrame:
    """What ``confidence_band_errors`` is worked out from, one row; rows of several parts of the results add up."""
    confidence = F.col("rag_confidence").try_cast("double")
    error = F.abs(F.col("predicted_story_points") - F.col("actual_story_points")).cast("double")
    kept = estimated(results).select(F.nanvl(confidence, F.lit(None).cast("double")).alias("c"), error.alias("e"))
    bands = {"high": F.col("c") >= 0.70, "low": F.col("c") < 0.55}
    return kept.agg(*[x for name, band in bands.items() for x in (
        F.count_if(band).alias(f"{name}_n"), F.sum(F.when(band, F.col("e"))).alias(f"{name}_sum"),
        F.count(F.when(band, F.col("e"))).alias(f"{name}_known"),
    )])


def confidence_bands_of(sums: DataFrame) -> DataFrame:
    """``confidence_band_errors`` from one or more rows of sums."""
    names = ("high", "low")
    whole = sums.agg(*[x for b in names for x in (
        F.coalesce(F.sum(f"{b}_n"), F.lit(0)).alias(f"{b}_n"), _ratio(F.sum(f"{b}_sum"), F.sum(f"{b}_known")).alias(f"{b}_mae"))])
    parts = [x for b in names for x in (F.lit(b), F.col(f"{b}_n"), F.col(f"{b}_mae"))]
    return whole.select(F.stack(F.lit(len(names)), *parts).alias("band", "n", "mae"))


def confidence_band_errors(results: DataFrame) -> DataFrame:
    """Tickets and mean absolute error of the high (>= 0.70) and low (< 0.55) retrieval-confidence bands."""
    return confidence_bands_of(confidence_band_sums(results))


def confusion_counts(results: DataFrame, threshold: int = COMPLEX_THRESHOLD) -> DataFrame:
    """Complexity flag against actual points at or above the threshold, one row."""
    actual = F.coalesce(F.col("actual_story_points") >= threshold, F.lit(False))
    flagged = F.coalesce(F.col("complex_flag"), F.lit(False))
    return estimated(results).agg(
        F.count_if(actual & flagged).alias("true_positive"),
        F.count_if(~actual & flagged).alias("false_positive"),
        F.count_if(actual & ~flagged).alias("false_negative"),
        F.count_if(~actual & ~flagged).alias("true_negative"),
    )


def precision_recall_f1(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of confusion counts; an undefined one is zero."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return confusion.select(
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        # twice the product over the sum of the two shares, in terms of the counts
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def reconciliation_gaps(results: DataFrame) -> DataFrame:
    """Decomposed tickets with the difference between their subtasks' points and their own."""
    return results.filter(F.col("complex_flag") & (F.col("subtask_count") > 0)).select(
        "issue_key", "predicted_story_points", "subtask_points_sum",
        (F.col("subtask_points_sum") - F.col("predicted_story_points")).alias("gap"), "subtask_titles",
    )


def mean_reconciliation_gap(results: DataFrame) -> DataFrame:
    return reconciliation_gaps(results).agg(
        F.count(F.lit(1)).alias("n_decomposed"), F.avg("gap").alias("mean_gap")
    )
