"""Scores of two runs kept up to date: what new results change is added to a stored state, old results are not read again.

The state is a folder of batches. A batch holds how often each pair of points occurs, sums of the retrieval and confidence figures,
and sums over the pairs of the two runs that have become complete with it. The last need the errors of old rows, so keys and points of
every row are kept too; of those only the keys of new rows are read. A batch counts once its last part is written; one that was
lost on the way is written over by the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from storygauge.operators import metrics
from storygauge.plans.evaluate import as_rows
from storygauge.session import durable, staged_keys
from storygauge.sources.layout import _files, _names

RUNS = ("rag", "norag")
COUNTS = "run string, issue_key string, actual int, predicted int, n long"


def batches(spark: SparkSession, state: str) -> list[int]:
    """The complete batches of a state."""
    found = []
    for name in _names(spark, state):
        if name.startswith("batch-"):
            system, done = _files(spark, f"{state.rstrip('/')}/{name}/paired/_SUCCESS")
            found += [int(name.removeprefix("batch-"))] if system.exists(done) else []
    return sorted(found)


def _part(spark: SparkSession, state: str, part: str) -> DataFrame | None:
    paths = [f"{state.rstrip('/')}/batch-{b}/{part}" for b in batches(spark, state)]
    held = [p for p in paths if _files(spark, p)[0].exists(_files(spark, p)[1])]
    return spark.read.parquet(*held) if held else None


def add_results(spark: SparkSession, state: str, rag: DataFrame | None = None, norag: DataFrame | None = None) -> int:
    """Adds new results of either run, or both, to the state; returns the batch's number.

    The results are new rows: what is added twice counts twice, as it would in one table of all rows.
    """
    number = max(batches(spark, state), default=0) + 1
    at = f"{state.rstrip('/')}/batch-{number}"
    given = {run: df for run, df in zip(RUNS, (rag, norag)) if df is not None}
    if not given:
        raise ValueError("no results to add")
    new = {run: durable(metrics.run_counts(df)) for run, df in given.items()}
    none = spark.createDataFrame([], COUNTS)
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(run).alias("run"), "issue_key", F.col("actual").cast("int").alias("actual"),
                                                      F.col("predicted").cast("int").alias("predicted"), "n") for run, df in new.items()])
    write = lambda df, part: df.write.mode("overwrite").parquet(f"{at}/{part}")
    write(tagged, "counts")
    write(tagged.groupBy("run", "actual", "predicted").agg(F.sum("n").alias("n")), "pairs")
    if rag is not None and "similar_tickets_json" in rag.columns:
        write(metrics.retrieval_sums(rag), "retrieval")
    if rag is not None and "rag_confidence" in rag.columns:
        write(metrics.confidence_band_sums(rag), "confidence")
    keys, _ = staged_keys(tagged.select("issue_key").distinct())
    before = _part(spark, state, "counts")
    old = none if before is None else durable(before.join(keys, "issue_key", "left_semi"))
    of = lambda df, run: df.filter(F.col("run") == run)
    fresh = [(of(tagged, "rag"), of(tagged, "norag")), (of(tagged, "rag"), of(old, "norag")), (of(old, "rag"), of(tagged, "norag"))]
    write(reduce(DataFrame.unionByName, [metrics.paired_sums(a, b) for a, b in fresh]), "paired")  # complete from here on
    return number


def kept_report(spark: SparkSession, state: str) -> DataFrame:
    """The rows of ``evaluate.ablation_report`` over all results that were added."""
    pairs = _part(spark, state, "pairs")
    if pairs is None:
        raise ValueError(f"no results were added to {state}")
    pairs = durable(pairs.groupBy("run", "actual", "predicted").agg(F.sum("n").alias("n")))
    parts = [as_rows(metrics.error_scores(pairs.filter(F.col("run") == run).drop("run")), run) for run in RUNS]
    parts.append(as_rows(metrics.comparison_of(_part(spark, state, "paired")), "paired"))
    retrieval, confidence = _part(spark, state, "retrieval"), _part(spark, state, "confidence")
    if retrieval is not None:
        parts.append(as_rows(metrics.retrieval_of(retrieval), "retrieval"))
    if confidence is not None:
        parts.append(as_rows(metrics.confidence_bands_of(confidence), "confidence", F.col("band")))
    return reduce(DataFrame.unionByName, parts)
