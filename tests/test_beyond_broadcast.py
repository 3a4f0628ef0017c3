"""The same results where nothing may be broadcast."""

import datetime

import pytest
from pyspark.sql import functions as F

import storygauge.session
from storygauge.operators import ingest, neighbours as nn, sampling
from storygauge.schemas import VECTORS


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storygauge.session, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(nn, "BROADCAST_ROWS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def both(request, build):
    with_ = build()
    request.getfixturevalue("no_broadcast")
    return with_, build()


def test_sampling_and_split(spark, request):
    rows = [(f"k{i % 700}", 1 + i % 4, f"t{i % 900}") for i in range(2000)]
    df = spark.createDataFrame(rows, "issue_key string, actual_story_points int, t string").repartition(5)

    def build():
        sample = sampling.take_per_class(df, F.col("actual_story_points"), sampling.EvenShare(0.3), ("issue_key",))
        return sorted(map(tuple, sample.collect())), sorted(map(tuple, sampling.mark_split(df, 0.8).collect()))

    a, b = both(request, build)
    assert a == b and len(a[0]) == 600 and len(a[1]) == 2000


def test_neighbours(spark, request):
    c = spark.createDataFrame([(f"c{i}", [float(i % 7), 1.0, float(i % 5)], i % 9, f"t{i}") for i in range(120)],
                              "issue_key string, embedding array<double>, story_points int, title string")
    q = spark.createDataFrame([(f"q{i}", [1.0, float(i), 2.0]) for i in range(20)], "query_key string, query_vector array<double>")

    def build():
        index = nn.CellIndex(nn.np.eye(3))
        exact = nn.nearest(q, c, 4, fetch=("title",)).select("query_key", "issue_key", "rank", "title", "similarity")
        cells = nn.approximate_neighbours(q, c, index, 4, probes=2, block_rows=16).select("query_key", "issue_key", "rank")
        return sorted(map(tuple, exact.collect())), sorted(map(tuple, cells.collect()))

    a, b = both(request, build)
    assert a == b and len(a[0]) == 80


def test_upsert_and_pending(spark, request):
    old = datetime.datetime(2020, 1, 1)
    stored = spark.createDataFrame([(f"k{i}", "t", "d", i, [1.0], "m", old) for i in range(50)], VECTORS)
    fresh = spark.createDataFrame([(f"k{i}", "t", "d", -i, [1.0], "m", old) for i in range(40, 60)], VECTORS)
    tickets = spark.createDataFrame([(f"k{i % 70}", i) for i in range(140)], "issue_key string, n int")

    def build():
        merged = ingest.upsert_vectors(stored, fresh).select("issue_key", "story_points")
        return sorted(map(tuple, merged.collect())), sorted(map(tuple, ingest.pending_rows(tickets, stored, "m").collect()))

    a, b = both(request, build)
    assert a == b and len(a[0]) == 60 and len(a[1]) == 20
