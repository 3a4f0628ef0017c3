import numpy as np
import pytest
from pyspark.sql import functions as F

from storygauge.functions import similarity as fv
from storygauge.operators import neighbours as nn


def brute_force(queries, corpus, k):
    """Ranked (query, key, similarity) by plain loops."""
    out = []
    for qk, qv in queries:
        scored = []
        for ck, cv in corpus:
            a, b = np.asarray(qv, float), np.asarray(cv, float)
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12), ck))
        out += [(qk, ck, rank, round(-s, 4)) for rank, (s, ck) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def frames(spark, queries, corpus):
    q = spark.createDataFrame(queries, "query_key string, query_vector array<double>")
    c = spark.createDataFrame([(k, v, i % 8) for i, (k, v) in enumerate(corpus)], "issue_key string, embedding array<double>, story_points int")
    return q, c


def found(df):
    return sorted((r.query_key, r.issue_key, r.rank, r.similarity) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    corpus = [(f"C-{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(300, 12)))]
    corpus += [(f"D-{i:03d}", corpus[0][1]) for i in range(150)]  # a third of the corpus is one vector
    queries = [(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(40, 12)))] + [("same", corpus[0][1])]
    return queries, corpus


def test_scan_equals_brute_force(spark, data):
    q, c = frames(spark, *data)
    assert found(nn.nearest(q, c.repartition(5), 7)) == brute_force(*data, 7)


def test_blocks_equal_brute_force(spark, data):
    q, c = frames(spark, *data)
    got = nn.nearest(q, c, 7, broadcast_bytes=8 * 12 * 15)  # three scans
    assert found(got) == brute_force(*data, 7)


def test_seeded_floors_keep_the_result_and_thin_the_scan(spark, data, monkeypatch):
    q, c = frames(spark, *data)
    c = c.repartition(30)
    assert found(nn.nearest(q, c, 7, seed_rows=40)) == brute_force(*data, 7)
    rows = {}
    scan = nn._scan_against

    def counted(table, corpus, k, key, payload, fields, dimension, floors=None):
        out = scan(table, corpus, k, key, payload, fields, dimension, floors)
        rows[floors is not None] = out.count()
        return out

    monkeypatch.setattr(nn, "_scan_against", counted)
    nn.nearest(q, c, 7, seed_rows=100).count()
    nn.nearest(q, c, 7, seed_rows=1 << 20).count()
    assert rows[True] < 0.6 * rows[False]


def test_a_query_is_encoded_once(spark, data):
    """On either side of the broadcast bound."""
    _, c = frames(spark, *data)
    for bound in (1 << 20, 8 * 12 * 15):
        calls = spark.sparkContext.accumulator(0)

        @F.udf("array<double>")
        def encode(i):
            calls.add(1)
            return [float(i + j) for j in range(12)]

        q = spark.range(40).select(F.concat(F.lit("q"), "id").alias("query_key"), encode.asNondeterministic()("id").alias("query_vector"))
        assert nn.nearest(q, c, 3, broadcast_bytes=bound).count() == 120
        assert calls.value == 40


def test_size_checks_bring_no_rows_together(spark, data, capsys):
    """No plan limits rows in one task to learn how many there are."""
    from storygauge.operators import ingest, sampling

    tickets = spark.createDataFrame([(f"k{i}", i % 4) for i in range(50)], "issue_key string, actual_story_points int")
    stored = spark.createDataFrame([("k1", "m")], "issue_key string, embedding_model string")
    q, c = frames(spark, *data)
    plans = [ingest.not_yet_stored(tickets, stored, "m"), sampling.mark_split(tickets), sampling.stratified_sample(tickets, 2), nn.nearest(q, c, 3)]
    for df in plans:
        assert "GlobalLimit" not in df._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_stored_with_the_vectors(spark, tmp_path):
    from storygauge.operators.encode import CallableEncoder
    from storygauge.operators.ingest import embed_tickets
    from storygauge.plans import lookup
    from storygauge.sources.vectors import read_vectors, write_vectors

    encoder = CallableEncoder("len-3", 3, lambda: (lambda texts: [[float(len(t)), float(t.count("a")), 3.0] for t in texts]))
    tickets = spark.createDataFrame([(f"C-{i}", "P", "Bug", f"t{i}", "a" * (i % 13) + "b" * (i % 7 + 1), i % 8) for i in range(90)],
                                    "issue_key string, project string, issue_type string, title string, description string, actual_story_points int")
    vectors = embed_tickets(tickets, encoder)
    index = nn.CellIndex.fit(vectors, 5)
    index.save(spark, str(tmp_path / "index"))
    write_vectors(vectors, str(tmp_path / "vectors"), index=index)
    again = nn.CellIndex.load(spark, str(tmp_path / "index"))
    assert np.allclose(again.centres, index.centres)
    stored = read_vectors(spark, str(tmp_path / "vectors"), "len-3", indexed=True)
    assert stored.count() == 90 and stored.columns[-1] == "cell"
    asked = tickets.select("description").limit(20)
    exact = lookup.find_similar(asked, read_vectors(spark, str(tmp_path / "vectors"), "len-3"), encoder, 4)
    whole = lookup.find_similar(asked, stored, encoder, 4, index=again, probes=5)
    columns = ["query_key", "rank", "issue_key", "similarity", "title", "description"]
    assert sorted(whole.select(columns).collect()) == sorted(exact.select(columns).collect())
    again.assign = lambda df, vector, probes=1: index.assign(df, vector, probes) if vector == "query_vector" else pytest.fail("assigned again")
    few = lookup.find_similar(asked, stored, encoder, 4, index=again, probes=1)
    plan = few._jdf.queryExecution().toString()
    assert any("cell" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    with pytest.raises(ValueError, match="fewer cells"):
        nn.CellIndex(np.zeros((1 << 12, 1 << 13)))


def test_cells_learn_from_every_row(spark):
    rows = [(f"a{i}", [1.0, 0.0]) for i in range(500)] + [("far", [0.0, 1.0])]
    c = spark.createDataFrame(rows, "issue_key string, embedding array<double>")
    assert {tuple(np.round(x, 6)) for x in nn.CellIndex.fit(c, 2).centres} == {(1.0, 0.0), (0.0, 1.0)}


def test_cells_equal_brute_force_when_all_are_probed(spark, data):
    q, c = frames(spark, *data)
    index = nn.CellIndex.fit(c, 6)
    assert found(nn.approximate_neighbours(q, c, index, 7, probes=6, block_rows=20)) == brute_force(*data, 7)


def test_fewer_probes_keep_most_neighbours(spark, data):
    q, c = frames(spark, *data)
    index = nn.CellIndex.fit(c, 6)
    approximate = nn.approximate_neighbours(q, c, index, 7, probes=3)
    row = nn.recall(approximate, nn.nearest(q, c, 7)).head()
    assert row.n_exact == 41 * 7 and row.recall > 0.5
    exact_keys = {k for k, _ in data[1]}
    assert {r.issue_key for r in approximate.collect()} <= exact_keys


def test_stored_cells_are_used_as_they_are(spark, data, tmp_path):
    q, c = frames(spark, *data)
    index = nn.CellIndex.fit(c, 4)
    index.assign(nn.searchable(c), "embedding").write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert found(nn.approximate_neighbours(q, stored, index, 5, probes=2)) == found(nn.approximate_neighbours(q, c, index, 5, probes=2))


def test_a_crowded_cell_is_cut_into_blocks(spark, data):
    q, c = frames(spark, *data)
    index = nn.CellIndex.fit(c, 2)
    sizes = index.assign(c, "embedding").groupBy("cell").count().agg(F.max("count")).head()[0]
    assert sizes >= 150
    assert found(nn.approximate_neighbours(q, c, index, 3, probes=2, block_rows=10)) == brute_force(*data, 3)


def test_unusable_vectors_are_left_out_and_counted(spark):
    rows = [("a", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("null", None), ("b", [0.0, 2.0])]
    c = spark.createDataFrame(rows, "issue_key string, embedding array<double>").withColumn("story_points", F.lit(1))
    q = spark.createDataFrame([("q", [3.0, 0.0]), ("z", [0.0, 0.0])], "query_key string, query_vector array<double>")
    assert found(nn.nearest(q, c, 5)) == [("q", "a", 1, 1.0), ("q", "b", 2, 0.0)]
    row = nn.vector_quality(c).head()
    assert (row.total, row.missing, row.zero, row.usable) == (4, 1, 1, 2)


def test_vectors_of_another_length_are_an_error(spark):
    q, c = frames(spark, [("q", [1.0, 0.0])], [("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0])])
    with pytest.raises(Exception, match="cannot be compared"):
        nn.nearest(q, c, 5).collect()


def test_no_queries(spark):
    q, c = frames(spark, [("q", [1.0])], [("a", [1.0])])
    assert nn.nearest(q.filter("false"), c, 5).collect() == []


def test_k_is_honoured_and_clamped_in_lookups(spark):
    assert [nn.clamp_k(k) for k in (-1, 0, 1, 50, 51)] == [1, 1, 1, 50, 50]
    q, c = frames(spark, [("q", [1.0, 0.5])], [(f"a{i:02d}", [1.0, float(i)]) for i in range(80)])
    assert nn.nearest(q, c, 500).count() == 80 and nn.clamp_k(500, 60) == 60


def test_rank_follows_similarity(spark, data):
    q, c = frames(spark, *data)
    rows = nn.nearest(q, c, 10).orderBy("query_key", "rank").collect()
    for a, b in zip(rows, rows[1:]):
        if a.query_key == b.query_key:
            assert b.rank == a.rank + 1 and b.similarity <= a.similarity


def test_neighbour_texts_come_with_the_rows(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0], 3, "T", "D")], "issue_key string, embedding array<float>, story_points int, title string, description string")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_key string, query_vector array<double>")
    for bound in (1 << 20, 8):
        (r,) = nn.nearest(q, c, 3, fetch=("title", "description"), broadcast_bytes=bound).collect()
        assert (r.query_key, r.issue_key, r.story_points, r.title, r.description, r.similarity) == ("q", "a", 3, "T", "D", 1.0)


def test_vectors_never_shuffle_in_the_scan(spark, data):
    q, c = frames(spark, *data)
    plan = nn.nearest(q, c, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.index("Exchange") < plan.index("MapInArrow")  # what is exchanged comes out of the scan


def test_column_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(fv.cosine(F.col("a"), F.col("b")), fv.unit(F.col("a")), fv.usable(F.col("a"))).collect()
    assert got[0][0] == pytest.approx(0.96) and got[0][1] == pytest.approx([0.6, 0.8]) and got[0][2]
    assert [tuple(r) for r in got[1:]] == [(None, None, False), (None, None, False)]


def test_a_crowd_of_equal_vectors_stays_inside_the_product():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    vectors = unit(np.vstack([np.tile(rng.normal(size=(1, 8)), (4000, 1)), rng.normal(size=(1000, 8))]))
    best = nn._Best(unit(rng.normal(size=(50, 8))), 5)
    keys = pa.array([f"K{i:05d}" for i in rng.permutation(5000)])
    chosen = best._best_of(np.round(best.queries @ vectors.T, 12), np.argsort(keys.to_numpy(zero_copy_only=False)))
    assert chosen.sum(axis=1).max() <= 10
    best.add(keys, vectors, [], [])
    got = best.rows.to_pandas()
    for q, rows in got.groupby("q"):
        sims = np.round(best.queries[q] @ vectors.T, 12)
        expected = sorted(zip(-sims, keys.to_pylist()))[:5]
        assert list(rows["key"]) == [k for _, k in expected]


def test_usual_probes_find_nine_tenths(spark, data):
    q, c = frames(spark, *data)
    for cells in (6, 16, 40):
        index = nn.CellIndex.fit(c, cells)
        found_ = nn.approximate_neighbours(q, c, index, 7)
        assert nn.recall(found_, nn.nearest(q, c, 7)).head().recall >= 0.9
