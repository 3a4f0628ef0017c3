"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storygauge import session

SPACES = "\t\n\x0b\x0c\r"  # with the blank: the white space that separates words everywhere in this folder
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1_000
BROADCAST_ROWS = 200_000  # rows of a staged key table, counted beforehand, that may go to every executor


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/documents.parquet")


def name_folder(spark: SparkSession) -> None:
    """Gives a local session that names no shared folder, as in tests, a private one; a cluster must name its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))


def durable(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder, their lineage cut."""
    name_folder(df.sparkSession)
    return session.durable(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def unit_interval(hashed: Column) -> Column:
    """A 64-bit hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(hashed, 12).cast("double") + 0.5) / float(1 << 52)


def staged(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows in the shared folder, and how many there are."""
    kept = durable(df)
    return kept, kept.count()


def small_side(kept: DataFrame, rows: int) -> DataFrame:
    """The broadcast hint where the counted rows allow it; otherwise both sides of a join are shuffled."""
    return F.broadcast(kept) if rows <= BROADCAST_ROWS else kept


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) with further columns named; other columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def small_batches(spark: SparkSession) -> None:
    """Sends at most 1,000 texts at a time to a Python worker, so that its memory does not grow with a task's input."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def per_process(name: str, make: Callable[[], object]) -> object:
    """A value that a Python worker makes once and keeps for all its tasks, whose code arrives anew with each task."""
    held = sys.modules.setdefault("_corpus_worker", types.ModuleType("_corpus_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]
