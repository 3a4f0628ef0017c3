"""What a search holds in a task, sends to the driver or repeats is bounded, and its results stay whole."""

import glob

import numpy as np
import pyspark.sql.classic.dataframe as classic
import pytest
from pyspark.sql import functions as F

from storygauge.operators import index as ix, neighbours as nn
from storygauge.schemas import TICKETS
from test_neighbours import brute_force, found, frames


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    rows = lambda n, key: [(f"{key}{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(n, 12)))]
    return rows(60, "q"), rows(400, "c")


@pytest.fixture
def vectors_to_driver(monkeypatch):
    """Rows with a query's vector that ``toArrow`` brought to the driver."""
    rows, real = [], classic.DataFrame.toArrow

    def counted(self):
        table = real(self)
        if "query_vector" in table.column_names:
            rows.append(table.num_rows)
        return table

    monkeypatch.setattr(classic.DataFrame, "toArrow", counted)
    return rows


def test_best_rows_are_compared_by_chunks(monkeypatch):
    """The rows held beyond the best ones are those of a chunk of queries, not of all."""
    import pyarrow as pa

    monkeypatch.setattr(nn, "CHUNK_ROWS", 100, raising=False)
    rng = np.random.default_rng(2)
    queries, vectors = unit(rng.normal(size=(300, 6))), unit(rng.normal(size=(900, 6)))
    best, sorted_rows = nn._Best(queries, 5), []
    prune = best._prune
    best._prune = lambda *a: (sorted_rows.append(max(p.num_rows for p in best.parts.values()) if hasattr(best, "parts") else best.rows.num_rows), prune(*a))
    keys = [f"k{i:03d}" for i in rng.permutation(900)]
    for lo in range(0, 900, 100):
        best.add(pa.array(keys[lo:lo + 100]), vectors[lo:lo + 100], [], [])
    for q, rows in best.rows.to_pandas().groupby("q"):
        expected = sorted(zip(-np.round(queries[q] @ vectors.T, 12), keys))[:5]
        assert list(rows["key"]) == [k for _, k in expected]
    assert max(sorted_rows) <= 20 * (4 * 5 + 8) < 300 * 5


def test_tables_of_products_are_made_for_a_chunk(spark, data, monkeypatch):
    q, c = frames(spark, *data)
    index = ix.VectorIndex.fit(c, 4)
    monkeypatch.setattr(nn, "CHUNK_ROWS", 100, raising=False)
    sizes, real = [], ix.Codebook.tables
    monkeypatch.setattr(ix.Codebook, "tables", lambda self, queries: (sizes.append(len(queries)), real(self, queries))[1])
    units = unit(np.array([v for _, v in data[0]]))
    best = ix._CodedBest(units, 20, index.codebook)
    codes = index.codebook.encode(unit(np.array([v for _, v in data[1]])))
    best.add(ix.pa.array([k for k, _ in data[1]]), codes, [], [])
    assert max(sizes) <= 5 and best.rows.num_rows == 60 * 20


def test_best_rows_a_task_holds_are_bounded(spark, data, monkeypatch):
    assert nn.queries_at_once(64, 10, nn.BROADCAST_BYTES) == nn.BROADCAST_BYTES // (8 * 64)
    assert nn.queries_at_once(26, 50, nn.BROADCAST_BYTES) * 50 * nn.ROW_BYTES <= nn.HELD_BYTES
    monkeypatch.setattr(nn, "HELD_BYTES", nn.ROW_BYTES * 30 * 25)
    q, c = frames(spark, *data)
    assert found(nn.nearest(q, c, 30, seed_rows=40)) == brute_force(*data, 30)  # three scans, each with floors of its own


def test_queries_of_one_scan_are_bounded_however_many_there_are(spark, data, monkeypatch):
    monkeypatch.setattr(nn, "SCAN_QUERIES", 25, raising=False)
    sizes, real = [], nn._scan_against
    monkeypatch.setattr(nn, "_scan_against", lambda table, *a, **b: (sizes.append(table.num_rows), real(table, *a, **b))[1])
    q, c = frames(spark, *data)
    assert found(nn.nearest(q, c, 7)) == brute_force(*data, 7)
    assert sum(sizes) == 60 and len(sizes) == 3 and max(sizes) < 60  # as many scans as the bound asks for, each with a part by key hash


def test_a_small_bound_does_not_scan_the_corpus_again_and_again(spark, data, monkeypatch):
    scans, real = [], nn._scan_against
    monkeypatch.setattr(nn, "_scan_against", lambda *a, **b: (scans.append(1), real(*a, **b))[1])
    q, c = frames(spark, *data)
    assert found(nn.nearest(q, c, 7, broadcast_bytes=8 * 12 * 2)) == brute_force(*data, 7)
    assert len(scans) <= 16


def test_small_blocks_do_not_repeat_every_row_for_each(spark):
    q = spark.range(1000).select(F.col("id").alias("query_key"), F.lit(0).alias("cell"))
    c = spark.range(2000).select(F.col("id").alias("issue_key"), F.lit(0).alias("cell"))
    left, right = nn._with_block_counts(q, c, c.select("cell"), 10)
    assert left.agg(F.max("c_blocks")).head()[0] <= 2 and right.agg(F.max("q_blocks")).head()[0] <= 2
    counts = spark.range(1).select(nn._blocks(F.lit(1 << 20), 64, 2).alias("n"), nn._blocks(F.lit(5), 64, 2).alias("one"))
    assert tuple(counts.head()) == ((1 << 20) // nn.WIDE_BLOCK_ROWS, 1)


def test_a_vector_reaches_the_driver_once_however_many_cells_are_read(spark, data, vectors_to_driver):
    q, c = frames(spark, *data)
    index = ix.VectorIndex.fit(c, 8)
    stored = index.place(nn.searchable(c)).drop("apart").checkpoint()
    vectors_to_driver.clear()
    assert found(ix.nearest_by_cells(q, stored, index, 7)) == brute_force(*data, 7)
    assert sum(vectors_to_driver) <= 2 * 60  # once for the nearest cells, once for the rest


def test_repeated_query_keys_ask_for_themselves(spark, data, monkeypatch):
    """Also where a shortlist is too long to broadcast: the same rows as where it is not."""
    queries = data[0] + data[0][:5] + [(k, data[0][9][1]) for k, _ in data[0][5:8]] + [(None, data[0][3][1])]
    q, c = frames(spark, queries, data[1] + data[1][:20])
    index = ix.VectorIndex.fit(c, 4)
    stored = index.place(nn.searchable(c)).drop("apart").checkpoint()
    rows = lambda: sorted(map(str, ix.coded_neighbours(q, stored, index, 5).collect()))
    small = rows()
    monkeypatch.setattr(ix, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ix, "COMPARED_ROWS", 7, raising=False)
    plan = ix.coded_neighbours(q, stored, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert rows() == small and "query_vector" not in plan  # the vectors of the queries are not joined to the pairs


def test_no_task_writes_the_whole_file_to_split(spark, tmp_path, monkeypatch):
    from standins import queries

    rows = [(f"k{i}", "P", "Bug", f"t {i}", 'a, "b"\n' * (i % 3), i % 5) for i in range(200)]
    monkeypatch.setattr(queries, "tickets_of", lambda t: spark.createDataFrame(rows, TICKETS).repartition(4))
    monkeypatch.setattr(queries, "scratch", lambda s, name: str(tmp_path / name))
    got = queries.QUERIES["tickets_through_split_csv"](spark, str(tmp_path))
    assert got.count() == 200 and len(glob.glob(str(tmp_path / "split-csv" / "*.csv"))) == 4


def spread(rng, n, width):
    """Vectors that are large in few directions."""
    return unit(np.abs(rng.normal(size=(n, width)) * np.geomspace(1, 0.01, width) + 0.2))


@pytest.mark.parametrize("bounds", ["none", "all", "some"])
def test_vectors_are_screened_before_they_are_compared_in_full(monkeypatch, bounds):
    """With bounds few pairs are compared in full, and the best rows are those of brute force."""
    import pyarrow as pa

    monkeypatch.setattr(nn, "SCREEN_ROWS", 512, raising=False)
    rng = np.random.default_rng(5)
    queries, vectors = spread(rng, 150, 20), spread(rng, 4_003, 20)
    vectors[100:140] = vectors[7]  # a crowd that ties
    queries[0] = vectors[7]
    sims, keys = np.round(queries @ vectors.T, 12), np.array([f"k{i:04d}" for i in rng.permutation(len(vectors))])
    floor = {"none": None, "all": np.sort(sims, 1)[:, -4], "some": np.where(np.arange(150) % 5, np.sort(sims, 1)[:, -4], -np.inf)}[bounds]
    best, compared = nn._Best(queries, 4, floor), []
    similar = best._similar
    best._similar = lambda places, rows: (compared.append(len(places) * len(rows)), similar(places, rows))[1]
    for lo in range(0, len(vectors), 1_500):
        best.add(pa.array(keys[lo:lo + 1_500]), vectors[lo:lo + 1_500], [], [])
    for q, rows in best.rows.to_pandas().groupby("q"):
        assert list(rows["key"]) == [k for _, k in sorted(zip(-sims[q], keys))[:4]]
    assert sum(compared) < {"none": 0.5, "all": 0.2, "some": 0.5}[bounds] * len(queries) * len(vectors)


def test_a_shortened_product_is_an_upper_bound():
    rng = np.random.default_rng(6)
    for width in (1, 2, 7, 64):
        queries, vectors = unit(rng.normal(size=(40, width))), unit(rng.normal(size=(90, width)))
        screen = nn._Screen(queries)
        assert (screen.own @ screen.short(vectors).T >= queries @ vectors.T - nn.SCREEN_SLACK).all()


def test_a_part_that_gives_bounds_is_searched_with_bounds(spark, data, monkeypatch):
    """The part of a large corpus that is searched first is itself searched with the bounds of a part of it."""
    queries, corpus = data
    given, real = [], nn._scan_against
    monkeypatch.setattr(nn, "_scan_against", lambda *a, **o: (given.append((a + (None,) * 8)[7] is not None), real(*a, **o))[1])
    monkeypatch.setattr(nn, "SEED_SHARE", 4)
    q, c = frames(spark, queries, corpus)
    assert found(nn.nearest(q, c, 1, seed_rows=8)) == brute_force(queries, corpus, 1)
    assert given == [False, True, True]


def test_a_lookup_in_all_cells_copies_no_query_for_each_cell(spark, monkeypatch):
    from storygauge.operators.encode import CallableEncoder
    from storygauge.operators.ingest import embed_tickets
    from storygauge.plans import lookup

    encoder = CallableEncoder("len-2", 2, lambda: (lambda texts: [[float(len(t)), float(t.count("a")) + 1] for t in texts]))
    rows = [(f"C-{i}", "P", "Bug", f"t{i}", "a" * (i % 13) + "b" * (i % 7 + 1), i % 8) for i in range(60)]
    tickets = spark.createDataFrame(rows, TICKETS)
    vectors = embed_tickets(tickets, encoder)
    index = nn.CellIndex.fit(vectors, 4)
    monkeypatch.setattr(lookup, "approximate_neighbours", lambda *a, **o: pytest.fail("searched by cells"))
    columns = ["query_key", "rank", "issue_key", "similarity", "title"]
    whole = lookup.find_similar(tickets, vectors, encoder, 4, index=index, probes=4).select(columns)
    assert sorted(whole.collect()) == sorted(lookup.find_similar(tickets, vectors, encoder, 4).select(columns).collect())
