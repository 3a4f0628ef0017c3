"""Keeping the vector table up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from storygauge.functions.text import embedding_text, strip
from storygauge.operators.cleaning import with_key
from storygauge.operators.encode import Encoder
from storygauge.schemas import VECTORS
from storygauge.session import durable, staged_keys


def not_yet_stored(tickets: DataFrame, stored: DataFrame, model: str, key: str = "issue_key") -> DataFrame:
    """Tickets whose key has no vector of this model.

    Stored keys are first reduced to those of the tickets: a small batch against a large table scans the stored key
    column and shuffles neither side.
    """
    keys, small = staged_keys(tickets.select(strip(F.col(key)).alias("_key")).distinct())
    known = stored.filter(F.col("embedding_model") == model).select(F.col(key).alias("_key")).join(keys, "_key", "left_semi")
    known = known.withColumnRenamed("_key", "_known")
    # known keys are some of the keys counted above
    return tickets.join(F.broadcast(known) if small else known, strip(tickets[key]) == F.col("_known"), "left_anti")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """One row per key: the last in ``order``, or the greatest row where there is no order.

    An aggregation, so copies of a frequent key are merged before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [] if order is None else [order.alias("_order")]
    best = df.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def upsert_vectors(stored: DataFrame, fresh: DataFrame, one_model: bool = False, order: Column | None = None) -> DataFrame:
    """The vector table after writing ``fresh`` over it; touched rows get a new ``created_at``.

    A row is replaced by one of the same key and model; with ``one_model`` by one of the same key, whatever model.
    """
    keys = ["issue_key"] if one_model else ["issue_key", "embedding_model"]
    latest = last_per_key(fresh, keys, order).withColumn("created_at", F.current_timestamp())
    columns = VECTORS.fieldNames()
    return without_keys(stored, fresh, keys).select(*columns).unionByName(latest.select(*columns))


def without_keys(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows that ``fresh`` does not replace; the stored vectors are not shuffled for a small ``fresh``."""
    touched, _ = staged_keys(fresh.select(*keys).distinct())
    return stored.join(touched, list(keys), "left_anti")


def pending_rows(
    tickets: DataFrame, stored: DataFrame | None, model: str, *, force: bool = False, order: Column | None = None
) -> DataFrame:
    """Tickets still to embed, one per key; blank keys are left out."""
    usable = with_key(tickets)
    todo = usable if force or stored is None else not_yet_stored(usable, stored, model)
    return last_per_key(todo.withColumn("issue_key", strip(F.col("issue_key"))), ["issue_key"], order)


def embed_tickets(pending: DataFrame, encoder: Encoder, include_title: bool = False) -> DataFrame:
    """Vector-table rows of tickets."""
    texts = pending.withColumn("_embed", embedding_text(F.col("title"), F.col("description"), include_title))
    return encoder.transform(texts, "_embed").select(
        "issue_key",
        F.nullif(strip(F.col("title")), F.lit("")).alias("title"),
        strip(F.col("description")).alias("description"),
        F.col("actual_story_points").cast("int").alias("story_points"),
        "embedding",
        F.lit(encoder.model).alias("embedding_model"),
        F.current_timestamp().alias("created_at"),
    )


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in the given order, without bringing them together.

    A range-partitioned sort puts each stretch of the order in one partition. It is written to the checkpoint
    folder, so the partitions stay as they are; then each row's number is its place in its partition plus the rows
    of the partitions before. That last sum runs over one row per partition.
    """
    ordered = durable(df.orderBy(*order, F.monotonically_increasing_id()))
    place = ordered.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = place.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        place.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + 1)
        .select(*df.columns, name)
    )


def ticket_key(number: Column) -> Column:
    """``TKT-007``; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.lit("TKT-"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))


def highest_ticket_number(backlog: DataFrame) -> DataFrame:
    """Largest number among generated keys, zero without one; one row."""
    digits = F.nullif(F.regexp_extract("issue_key", r"^TKT-(\d+)$", 1), F.lit(""))
    return backlog.agg(F.coalesce(F.max(digits.try_cast("long")), F.lit(0)).alias("highest"))


def append_tickets(backlog: DataFrame, submissions: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The backlog with the submissions added under new keys, their fields stripped."""
    fields = ["project", "issue_type", "title", "description"]
    numbered = number_rows(submissions.select(*fields, *[o.alias(f"_o{i}") for i, o in enumerate(order)]),
                           [F.col(f"_o{i}") for i in range(len(order))])
    start = highest_ticket_number(backlog).scalar()
    added = numbered.select(
        ticket_key(start + F.col("number")).alias("issue_key"), *[strip(F.col(c)).alias(c) for c in fields]
    )
    return backlog.select("issue_key", *fields).unionByName(added)
