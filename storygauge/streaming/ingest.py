"""Ingest driven by a stream of tickets: new keys only, or with state that tells changed tickets from repeats."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storygauge.functions.text import embedding_text, strip
from storygauge.operators.cleaning import with_key
from storygauge.operators.encode import Encoder
from storygauge.plans.ingest import ingest

STATE_GROUPS = 4_096  # of keys that share a state; a checkpoint stands and falls with this number


def stream_ingest(
    tickets: DataFrame, store: str, encoder: Encoder, checkpoint: str, *, include_title: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Embed newly arriving tickets into the vector table.

    A batch that runs twice after a failure writes nothing the second time, because stored keys are skipped.
    """

    def write(batch: DataFrame, _: int) -> None:
        ingest(batch, store, encoder, include_title=include_title)

    writer = tickets.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changed_tickets(tickets: DataFrame, include_title: bool = False, order: str | None = None) -> DataFrame:
    """Of a stream, the tickets that are new or whose stored fields have changed since their key was last seen.

    State holds one digest a key: of the text to embed, the title and the points. Of several rows of a key in one batch the last in
    ``order`` counts, or the greatest row where there is none, so what comes out is at most one row a key and batch. Rows with a
    blank key are left out. Keys are dealt to ``STATE_GROUPS`` groups by their hash, since a call for every key costs far more than
    its row; whole numbers beyond 2**53 in a column that has NULLs are rounded, as pandas does.
    """
    keyed = with_key(tickets).withColumn("issue_key", strip(F.col("issue_key")))
    text = embedding_text(F.col("title"), F.col("description"), include_title)
    empty = F.lit("\u0000")
    parts = [text, strip(F.col("title")), strip(F.col("description")), F.col("actual_story_points").cast("string")]
    digest = F.md5(F.concat_ws("\u0001", *[F.coalesce(p, empty) for p in parts]))
    group = F.pmod(F.xxhash64("issue_key"), F.lit(STATE_GROUPS)).cast("int")
    rows = keyed.withColumns({"_digest": digest, "_group": group})
    columns = tickets.columns
    by = ([order] if order else []) + [c for c in columns if c not in ("issue_key", order)]
    fields = T.StructType([keyed.schema[c] for c in columns])

    def pick(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        last = None
        for frame in frames:  # no more than one row a key is carried from frame to frame
            held = frame if last is None else pd.concat([last, frame], ignore_index=True)
            last = held.sort_values(by, na_position="first", kind="stable").drop_duplicates("issue_key", keep="last")
        digests = dict(zip(last["issue_key"], last["_digest"]))
        changed = [known.get(key) != new for key, new in digests.items()]
        if any(changed):
            state.update((json.dumps({**known, **digests}),))
            yield last.loc[changed, columns]

    return rows.groupBy("_group").applyInPandasWithState(
        pick, outputStructType=fields, stateStructType="digests string", outputMode="update", timeoutConf=GroupStateTimeout.NoTimeout)


def stream_upserts(
    tickets: DataFrame, store: str, encoder: Encoder, checkpoint: str, *, include_title: bool = False, order: str | None = None,
    buckets: int | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Keep the vector table level with a stream of tickets: changed tickets are embedded again and written over, repeats are not.

    The table lies in cells or buckets, or is begun with so many ``buckets``. A batch that runs twice after a failure embeds the same
    tickets again and leaves the same rows, since state is kept only once the batch is written.
    """

    def write(batch: DataFrame, _: int) -> None:
        ingest(batch, store, encoder, force=True, include_title=include_title, buckets=buckets)

    changed = changed_tickets(tickets, include_title, order)
    writer = changed.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
