"""The stateful stream against the batch job."""

import os

import pytest
from pyspark.sql import functions as F

from storygauge.operators.encode import CallableEncoder
from storygauge.plans import ingest as job
from storygauge.schemas import TICKETS
from storygauge.sources.vectors import read_vectors
from storygauge.streaming.ingest import stream_upserts


def tickets(spark, rows):
    return spark.createDataFrame([(k, "P", "Bug", title, text, points) for k, title, text, points in rows], TICKETS).coalesce(2)


def counted(folder):
    def factory():
        def encode(texts):
            with open(os.path.join(folder, str(os.getpid())), "a") as notes:
                notes.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    return CallableEncoder("len-2", 2, factory)


def texts_in(folder):
    return sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().split("\n") if line)


def content(df):
    return sorted((r.issue_key, r.title or "", r.description or "", r.story_points if r.story_points is not None else -1, tuple(r.embedding)) for r in df.collect())


FIRST = [(f"K-{i}", f"t{i}", "x" * i, i % 8) for i in range(1, 30)] + [(" ", "blank", "key", 1), (None, "no", "key", 1)]
THEN = [(f"K-{i}", f"t{i}", "x" * i, i % 8) for i in range(6, 20)]  # repeats
CHANGED = [("K-3", "t3", "new text", 3), ("K-4", "t4", "xxxx", 8), ("K-40", "t", "first seen", 1), (" K-5 ", "t5", "xxxxx", 5)]


@pytest.mark.parametrize("order", [None, "actual_story_points"])
def test_two_batches_equal_the_batch_job(spark, tmp_path, order):
    source, store, other, notes = (str(tmp_path / n) for n in ("in", "store", "other", "notes"))
    os.mkdir(notes)
    encoder = counted(notes)
    for rows in (FIRST, THEN + CHANGED):
        tickets(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(TICKETS).parquet(source)
        stream_upserts(stream, store, encoder, str(tmp_path / "cp"), order=order, buckets=4).awaitTermination()
    embedded = texts_in(notes)
    assert len(embedded) == 29 + 3 and {"new text", "first seen"} <= set(embedded)  # K-5 is the same but for blanks around its key
    quiet = CallableEncoder("len-2", 2, lambda: (lambda texts: [[float(len(t)), 1.0] for t in texts]))
    job.ingest(tickets(spark, FIRST), other, quiet, buckets=4)
    job.ingest(tickets(spark, CHANGED), other, quiet, force=True)
    assert content(read_vectors(spark, store)) == content(read_vectors(spark, other))


def test_the_last_row_of_a_key_counts_and_going_back_is_a_change(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    encoder = CallableEncoder("len-2", 2, lambda: (lambda texts: [[float(len(t)), 1.0] for t in texts]))
    for rows in ([("A", "t", "one", 1), ("A", "t", "three", 3), ("A", "t", "two", 2)], [("A", "t", "one", 5)], [("A", "t", "three", 3)]):
        tickets(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(TICKETS).parquet(source)
        stream_upserts(stream, store, encoder, str(tmp_path / "cp"), order="actual_story_points", buckets=2).awaitTermination()
        last = max(rows, key=lambda r: r[3])
        assert [(r.description, r.story_points) for r in read_vectors(spark, store).collect()] == [(last[2], last[3])]
    before = read_vectors(spark, store).select(F.max("created_at")).head()[0]
    stream_upserts(spark.readStream.schema(TICKETS).parquet(source), store, encoder, str(tmp_path / "cp"), buckets=2).awaitTermination()
    assert read_vectors(spark, store).select(F.max("created_at")).head()[0] == before  # nothing new, nothing written


def test_keys_of_one_group_keep_their_own_digests(spark, tmp_path, monkeypatch):
    """The state is asked once a group of keys, not once a key, and tells every key's change apart."""
    from storygauge.streaming import ingest as si

    monkeypatch.setattr(si, "STATE_GROUPS", 3, raising=False)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(f'K"{i}', f"t{i}", f"text {i}", None if i % 7 == 0 else i) for i in range(60)] * 2
    then = [(k, t, x, 99 if k.endswith("5") else p) for k, t, x, p in first[:50]] + [('K"5', "t5", "text 5", 3), ("new", None, None, None)]
    got = []
    for rows in (first, then):
        tickets(spark, rows).write.mode("append").parquet(source)
        changed = si.changed_tickets(spark.readStream.schema(TICKETS).parquet(source))
        folder = f"{out}-{len(got)}"
        write = changed.writeStream.option("checkpointLocation", str(tmp_path / "cp")).outputMode("update")
        write.trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("append").parquet(folder)).start().awaitTermination()
        found = spark.read.parquet(folder)
        got.append(sorted((r.issue_key, r.title or "", r.description or "", r.actual_story_points or -1) for r in found.collect()))
    state = spark.read.format("statestore").load(str(tmp_path / "cp"))
    assert state.count() == 3
    shown = lambda rows: sorted({(k, t or "", x or "", p or -1) for k, t, x, p in rows})
    assert got[0] == shown(first)
    assert got[1] == shown([r for r in then[:50] if r[0].endswith("5")] + [then[-1]])
