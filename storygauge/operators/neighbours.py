"""Nearest tickets by cosine similarity, as a join of two DataFrames of vectors.

Pairs are never materialised. A block of corpus vectors meets a block of query vectors in one matrix product
inside a task, and only the best ``k`` rows per query leave it; a window over those finishes the ranking.

How the blocks meet depends on a checked size:

* The queries fit the broadcast bound: every task scans its own part of the corpus against them. The corpus is
  read once and not shuffled, and each task keeps one running top ``k`` per query.
* They do not, or are more than ``SCAN_QUERIES``: the queries are cut by key hash into slices that fit, and the corpus is scanned
  once for each slice. So the memory of a Python worker stops growing with the input.
* Many queries meet a large corpus (``parts.MANY_PAIRS``): parts of the corpus go to every task instead, and each task searches them
  for its own queries (``parts``). Only the best rows of a query leave a task.
* The bound lets only a handful of queries through at a time: both sides are cut into blocks that meet by an equi-join, and
  nothing is sent to every task.

The queries are staged first, and the corpus where it is scanned more than once, so a costly vector is made once whichever way
is taken. A large corpus is first searched in a part, chosen by key hash: the k-th best similarity there is a lower bound for
the whole, and with it most tasks of the full scan give back next to nothing. With such bounds a task first compares vectors in
half as many dimensions, those in which the queries are largest; only pairs that may still reach their bound are compared in full.

``approximate_neighbours`` works within cells of similar vectors: both sides are cut into blocks of bounded size by the
hash of their keys and meet by an equi-join on cell and block numbers. A cell of any size is cut into as many bounded
blocks as it needs, so a crowded cell costs more tasks, not a larger one. Blocks of few rows are cut wider, within that bound,
where each row would be repeated for too many of them.

Results are ranked by similarity (to 12 decimals, so that equal vectors tie) and then by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from storygauge.functions.rounding import round_exact
from storygauge.functions.similarity import unit, usable
from storygauge.operators import parts
from storygauge.schemas import DEFAULT_NEIGHBOURS, MAX_NEIGHBOURS
from storygauge.session import durable, staged_keys

BROADCAST_BYTES = 64 << 20  # query vectors that may be sent to every task
BROADCAST_ROWS = 500_000  # neighbour rows that may be
SCAN_QUERIES = 1 << 15  # queries of one scan of the corpus: what a worker holds grows with them
SEED_ROWS = 1 << 16  # rows of the part of a large corpus that is searched first
BLOCK_ROWS = 16_384  # rows of one block in the block join
PROBED_SHARE = 0.75  # of the cells of an index, searched unless told otherwise
CENTRE_BYTES = 128 << 20  # cell centres that may be sent to every task
KEEP_DECIMALS = 12
SLACK = 1e-11  # wide enough that rounding never drops a row that ties with the last one kept
SLAB = 1 << 18  # similarities computed at a time, few enough to stay in a core's cache
CHUNK_ROWS = 1 << 16  # best rows of the queries that are compared at a time, about
HELD_BYTES = 128 << 20  # best rows a task may hold
ROW_BYTES = 64  # of one best row, about
SCREENED = 1 << 18  # pairs screened at a time, few enough to stay in a core's cache
SCREEN_ROWS = 8_192  # rows added at a time, so that later ones meet a bound
SCREEN_SLACK = 1e-5  # wider than what single precision can do to a product of unit vectors
SCREEN_SHARE = 32  # a query with more than one row in so many left by the screen is compared with all rows
SEED_SHARE = 8  # the part of a large corpus that is searched first is at least one row in so many
MOST_SCANS = 16  # of a corpus, if each scan could take fewer queries than a quarter of a block
WIDE_BLOCK_ROWS = 65_536  # rows of one block in the block join where more blocks would repeat the rows too often


def clamp_k(k: int, max_k: int = MAX_NEIGHBOURS) -> int:
    """The number of neighbours a lookup gives: between 1 and ``max_k``."""
    return max(1, min(k, max_k))


def searchable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has a direction; NULL and zero vectors have no cosine similarity."""
    return df.filter(usable(F.col(vector)))


def vector_quality(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """How many vectors can be searched and how many cannot, one row."""
    v = F.col(vector)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(v.isNotNull() & ~usable(v)).alias("zero"),
        F.count_if(usable(v)).alias("usable"),
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int | None) -> np.ndarray:
    """Unit rows in double precision; a vector of another length is an error."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(array.offsets.to_numpy())
    width = dimension or int(lengths[0])
    if (lengths != width).any():
        raise ValueError(f"vectors of length {sorted(set(lengths.tolist()))} cannot be compared, expected {width}")
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, width)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _raw(table: pa.Table, vector: str, width: int) -> np.ndarray:
    """Rows as they are stored; a vector of another length is an error."""
    array = table[vector].combine_chunks()
    lengths = np.diff(array.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors of length {sorted(set(lengths.tolist()))} cannot be compared, expected {width}")
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _units(raw: np.ndarray) -> np.ndarray:
    rows = raw.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class _Screen:
    """An upper bound of the similarity of unit vectors: their product in a few directions and that of the lengths of the rest.

    The directions are those in which the queries are largest. A bound is never less than the similarity by more than ``SCREEN_SLACK``.
    """

    def __init__(self, queries: np.ndarray):
        self.turn = np.linalg.eigh(queries.T @ queries)[1][:, ::-1]
        self.own = self.short(queries)

    def short(self, vectors: np.ndarray) -> np.ndarray:
        most = self.turn.shape[1] // 2
        short = np.empty((len(vectors), most + 1), np.float32)
        for lo in range(0, len(vectors), SCREEN_ROWS):
            turned = vectors[lo:lo + SCREEN_ROWS] @ self.turn
            short[lo:lo + SCREEN_ROWS, :most] = turned[:, :most]
            short[lo:lo + SCREEN_ROWS, most] = np.linalg.norm(turned[:, most:], axis=1)
        return short


class _Best:
    """Running best ``k`` corpus rows of each query.

    The queries are compared a chunk at a time, and the rows held for a chunk are pruned once they have grown by half. So what
    is held beyond ``k`` rows a query is bounded however many queries there are.
    """

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()
        self.chunk = max(1, CHUNK_ROWS // k)
        self.screens: dict[int, _Screen] = {}  # by the first query of a chunk, as the parts
        self.parts: dict[int, pa.Table] = {}
        self.fresh: dict[int, int] = {}  # rows of a part that came after it was pruned

    def _similar(self, places: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return self.queries[places] @ vectors.T

    def add(
        self, keys: pa.Array, vectors: np.ndarray, payload: Sequence[pa.Array], names: Sequence[str], places: np.ndarray | None = None
    ) -> None:
        """Compares the vectors with all queries, or with those at ``places``, which ascend."""
        for lo in range(0, len(vectors), SCREEN_ROWS):
            part, by_key = slice(lo, lo + SCREEN_ROWS), None
            rows = keys[part], vectors[part], [column[part] for column in payload]
            for first in range(0, len(self.queries), self.chunk):
                last = min(first + self.chunk, len(self.queries))
                own = np.arange(first, last) if places is None else places[slice(*np.searchsorted(places, [first, last]))]
                if len(own):
                    by_key = self._add_to(first, own, *rows, names, by_key)

    def _screened(self, first: int, own: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The queries to compare with all vectors, and query, row and similarity of the pairs left of the others."""
        none = (np.empty(0, int), np.empty(0, int), np.empty(0))
        bounded = self.floor[own] > -np.inf
        if 2 * bounded.sum() < len(own) or min(len(own), len(vectors)) < 2 * self.queries.shape[1]:
            return own, none  # shortening the vectors would cost more than it saves
        if first not in self.screens:
            self.screens[first] = _Screen(self.queries[first:first + self.chunk])
        screen, open_ = self.screens[first], own[bounded]
        rows = np.zeros((-(-len(vectors) // 8) * 8, screen.own.shape[1]), np.float32)
        rows[:len(vectors)] = screen.short(vectors)
        rows = np.ascontiguousarray(rows.T)
        step = max(1, SCREENED // rows.shape[1])
        bounds, fit = np.empty((step, rows.shape[1]), np.float32), np.empty((step, rows.shape[1]), bool)
        dense, q_parts, c_parts, s_parts = [own[~bounded]], [none[0]], [none[1]], [none[2]]
        for lo in range(0, len(open_), step):
            some = open_[lo:lo + step]
            np.matmul(screen.own[some - first], rows, out=bounds[:len(some)])
            np.greater_equal(bounds[:len(some)], (self.floor[some] - SCREEN_SLACK).astype(np.float32)[:, None], out=fit[:len(some)])
            eights = np.flatnonzero(fit[:len(some)].reshape(-1).view(np.uint64))  # few of many: eight at a time
            which, place = np.nonzero(fit.reshape(-1, 8)[eights])
            q, c = np.divmod(eights[which] * 8 + place, rows.shape[1])
            left = np.bincount(q, minlength=len(some)) > max(4 * self.k, len(vectors) // SCREEN_SHARE)
            dense.append(some[left])
            chosen = ~left[q] & (c < len(vectors))
            q, c = some[q[chosen]], c[chosen]
            for a in range(0, len(q), SCREENED // 8):
                q_, c_ = q[a:a + SCREENED // 8], c[a:a + SCREENED // 8]
                sims = np.einsum("ij,ij->i", self.queries[q_], vectors[c_])
                reach = sims >= self.floor[q_] - SLACK
                q_parts.append(q_[reach])
                c_parts.append(c_[reach])
                s_parts.append(np.round(sims[reach], KEEP_DECIMALS))
        return np.concatenate(dense), (np.concatenate(q_parts), np.concatenate(c_parts), np.concatenate(s_parts))

    def _add_to(
        self, first: int, own: np.ndarray, keys: pa.Array, vectors: np.ndarray, payload: Sequence[pa.Array], names: Sequence[str],
        by_key: np.ndarray | None,
    ) -> np.ndarray | None:
        """Adds to one chunk; gives back the order of the keys if it was needed."""
        step = max(1, SLAB // max(1, len(vectors)))
        own, pairs = self._screened(first, own, vectors)
        q_parts, c_parts, s_parts = ([found] for found in pairs)
        for lo in range(0, len(own), step):
            some = own[lo:lo + step]
            sims = self._similar(some, vectors)
            better = sims >= (self.floor[some] - SLACK)[:, None]
            many = np.nonzero(better.sum(axis=1) > 4 * self.k)[0]
            if len(many):
                place = sims.shape[1] - self.k
                kth = np.partition(sims[many], place, axis=1)[:, place]
                better[many] = sims[many] >= (kth - SLACK)[:, None]
                crowded = many[better[many].sum(axis=1) > 4 * self.k]
                if len(crowded):
                    by_key = pc.sort_indices(keys).to_numpy() if by_key is None else by_key
                    better[crowded] = self._best_of(np.round(sims[crowded], KEEP_DECIMALS), by_key)
            q, c = np.nonzero(better)
            q_parts.append(some[q])
            c_parts.append(c)
            s_parts.append(np.round(sims[q, c], KEEP_DECIMALS))
        chosen = pa.array(np.concatenate(c_parts))
        if len(chosen) or first not in self.parts:
            found = pa.table(
                [pa.array(np.concatenate(q_parts)), keys.take(chosen), pa.array(np.concatenate(s_parts))]
                + [column.take(chosen) for column in payload],
                names=["q", "key", "sim", *names],
            )
            self.parts[first] = pa.concat_tables([self.parts[first], found]) if first in self.parts else found
            self.fresh[first] = self.fresh.get(first, 0) + len(chosen)
            if self.fresh[first] > min(self.chunk, len(self.queries) - first) * self.k // 2:
                self._prune(first)
        return by_key

    def _best_of(self, sims: np.ndarray, by_key: np.ndarray) -> np.ndarray:
        """Which similarities of each row can be among its best ``k``: all above the k-th largest, and of those equal
        to it the ``k`` with the smallest keys. So a crowd of equal vectors never leaves this product."""
        place = sims.shape[1] - self.k
        kth = np.partition(sims, place, axis=1)[:, place:place + 1]
        tied = (sims == kth)[:, by_key]
        chosen = sims > kth
        chosen[:, by_key] |= tied & (np.cumsum(tied, axis=1) <= self.k)
        return chosen

    def _prune(self, first: int) -> None:
        table = self.parts[first].combine_chunks().sort_by([("q", "ascending"), ("sim", "descending"), ("key", "ascending")])
        q = table["q"].to_numpy()
        starts = np.searchsorted(q, np.arange(first, min(first + self.chunk, len(self.queries))))
        place = np.arange(len(q)) - starts[q - first]
        self.parts[first], self.fresh[first] = table.filter(pa.array(place < self.k)), 0
        full = np.nonzero(place == self.k - 1)[0]
        self.floor[q[full]] = np.maximum(self.floor[q[full]], table["sim"].to_numpy()[full])

    def _pruned(self) -> Iterator[pa.Table]:
        for first in sorted(self.parts):
            if self.fresh[first]:
                self._prune(first)
            yield self.parts[first]

    @property
    def rows(self) -> pa.Table | None:
        return pa.concat_tables(self._pruned()) if self.parts else None

    def batches(self, query_keys: pa.Array, schema: pa.Schema, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
        for part in self._pruned():
            if part.num_rows:
                q = part["q"].combine_chunks()
                columns = [query_keys.take(q), part["key"], part["sim"]] + [part[n] for n in names]
                yield from pa.table(columns, schema=schema).combine_chunks().to_batches()


def _output(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, payload: Sequence[str]):
    fields = [
        T.StructField("query_key", queries.schema[query_key].dataType),
        T.StructField(key, corpus.schema[key].dataType),
        T.StructField("raw_similarity", T.DoubleType()),
    ] + [T.StructField(c, corpus.schema[c].dataType) for c in payload]
    return T.StructType(fields)


def _rank(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_key").orderBy(F.desc("raw_similarity"), F.asc(key))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("similarity", round_exact(F.col("raw_similarity"), 4))
        .drop("raw_similarity")
    )


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_NEIGHBOURS, *, query_key: str = "query_key",
    query_vector: str = "query_vector", key: str = "issue_key", vector: str = "embedding",
    payload: Sequence[str] = ("story_points",), fetch: Sequence[str] = (), dimension: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES, seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """Exact ``k`` nearest corpus rows of every query: query_key, key, payload, rank, similarity (4 decimals).

    Keys are unique on each side, as in the vector table. ``payload`` columns travel with the vectors; wide ones
    belong in ``fetch``, which looks them up for the rows found, without reading a vector again. Queries whose vector is
    of another length than ``dimension`` are an error, as are unequal lengths.
    """
    k = max(1, k)
    q = searchable(queries, query_vector).select(F.col(query_key).alias("query_key"), F.col(query_vector).alias("query_vector"))
    c = searchable(corpus, vector).select(key, F.col(vector).alias("_vector"), *payload)
    fields = _output(q, c, "query_key", key, payload)
    q = durable(q)
    count, width = q.agg(F.count(F.lit(1)), F.max(F.size("query_vector"))).head()
    at_once = min(queries_at_once(max(width or 1, dimension or 1), k, broadcast_bytes), SCAN_QUERIES)
    slices = -(-count // at_once)

    def scan(part: DataFrame) -> DataFrame:
        table = part.toArrow()  # a query's vector reaches the driver once
        floors = _floors(table, c, total, k, key, seed_rows, dimension) if table.num_rows else None
        return _rank(_scan_against(table, c, k, key, payload, fields, dimension, floors), key, k)

    if slices > MOST_SCANS and at_once < BLOCK_ROWS // 4:  # the corpus would be scanned for a handful of queries at a time
        if dimension and width != dimension:
            raise ValueError(f"vectors of length {width} cannot be compared, expected {dimension}")
        whole = lambda df: df.withColumn("cell", F.lit(0))
        sized = _with_block_counts(whole(q), whole(c), whole(c).select("cell"), BLOCK_ROWS, fewest=8)
        found = _rank(_block_join(*sized, k, key, payload, fields), key, k)
    elif (total := corpus.select(key).count()) * count > parts.MANY_PAIRS and count > parts.FEW_QUERIES:
        # the rows were counted without their vectors, which costs next to nothing on a stored table
        found = _rank(_by_parts(q, count, durable(c), total, k, key, payload, fields, width, dimension), key, k)
    else:
        if slices > 1 or (count and _seeded(total, k, seed_rows)):
            c = durable(c)  # a costly vector of the corpus is made once too
        if slices <= 1:
            found = scan(q)
        else:  # one scan of the corpus after the other, each leaving a bounded result behind
            found = reduce(DataFrame.unionByName, [durable(scan(_slice(q, i, slices))) for i in range(slices)])
    if fetch and count * k <= BROADCAST_ROWS:
        return with_columns_of(F.broadcast(found), corpus, key, fetch)  # the wide table is not shuffled
    return with_columns_of(found, corpus, key, fetch) if fetch else found


def _by_parts(
    queries: DataFrame, count: int, corpus: DataFrame, total: int, k: int, key: str, payload: Sequence[str], fields: T.StructType,
    width: int, dimension: int | None,
) -> DataFrame:
    if dimension and width != dimension:
        raise ValueError(f"vectors of length {width} cannot be compared, expected {dimension}")

    def askers(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, None]:
        units = _matrix(table["query_vector"], width)
        return table["query_key"].combine_chunks(), units, np.full(len(units), -np.inf), None

    raw, read = partial(_raw, vector="_vector", width=width), _units
    return reduce(DataFrame.unionByName, parts.by_parts(queries, count, corpus, total, k, key, payload, fields, width, askers, raw, read))


def queries_at_once(width: int, k: int, broadcast_bytes: int) -> int:
    """How many queries are sent to every task: their vectors fit the bound, and so do the best rows that a task holds for them."""
    return max(1, min(broadcast_bytes // (8 * width), HELD_BYTES // (ROW_BYTES * k)))


def _slice(queries: DataFrame, number: int, slices: int) -> DataFrame:
    return queries.filter(F.pmod(F.xxhash64("query_key"), F.lit(slices)) == number)


def _seeded(total: int, k: int, seed_rows: int) -> bool:
    return total > 4 * max(seed_rows, k)


def _floors(
    table: pa.Table, corpus: DataFrame, total: int, k: int, key: str, seed_rows: int, dimension: int | None
) -> dict | None:
    """For each query the k-th best similarity in a part of the corpus; None for a corpus that is not much larger.

    The part is chosen by key hash and has about ``seed_rows`` rows, or a fixed share of a very large corpus, so that no more than
    a fixed number of rows a query leaves the full scan, however many tasks it has. Such a share is itself searched with the
    bounds of a part of it. One number a query reaches the driver each time.
    """
    if not _seeded(total, k, seed_rows):
        return None
    sizes = [max(seed_rows, 4 * k, total // SEED_SHARE)]
    while _seeded(sizes[0], k, seed_rows):
        sizes.insert(0, max(seed_rows, 4 * k, sizes[0] // SEED_SHARE))
    fields = T.StructType([T.StructField("query_key", T.LongType()), corpus.schema[key], T.StructField("raw_similarity", T.DoubleType())])
    numbered = table.set_column(table.schema.get_field_index("query_key"), "query_key", pa.array(np.arange(table.num_rows)))
    order = Window.partitionBy("query_key").orderBy(F.desc("raw_similarity"))
    known: dict | None = None
    for size in sizes:
        part = corpus.filter(F.pmod(F.xxhash64(key), F.lit(total)) < F.lit(size)).select(key, "_vector")
        best = _scan_against(numbered, part, k, key, (), fields, dimension, known)
        kth = best.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == k)
        floors = kth.select("query_key", "raw_similarity").toArrow()
        known = dict(zip(floors["query_key"].to_pylist(), floors["raw_similarity"].to_pylist()))
    keys = table["query_key"].take(pa.array(list(known), pa.int64())).to_pylist()
    least: dict = {}
    for asked, floor in zip(keys, known.values()):
        least[asked] = min(floor, least.get(asked, floor))  # where a key is asked twice
    return least


def _scan_against(
    table: pa.Table, corpus: DataFrame, k: int, key: str, payload: Sequence[str], fields: T.StructType,
    dimension: int | None, floors: dict | None = None,
) -> DataFrame:
    if table.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], fields)
    query_keys = table["query_key"].combine_chunks()
    units = _matrix(table["query_vector"], dimension)
    least = None if floors is None else np.array([floors.get(x, -np.inf) for x in query_keys.to_pylist()])
    sent = corpus.sparkSession.sparkContext.broadcast((query_keys, units, least))
    names = list(payload)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_, units_, least_ = sent.value
        best, schema = _Best(units_, k, least_), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            extra = [batch.column(n) for n in names]
            best.add(batch.column(key), _matrix(batch.column("_vector"), units_.shape[1]), extra, names)
            schema = schema or _schema(keys_.type, batch.schema, key, names)
        if schema is not None:
            yield from best.batches(keys_, schema, names)

    return corpus.mapInArrow(scan, fields)


def _schema(query_type: pa.DataType, corpus: pa.Schema, key: str, names: Sequence[str]) -> pa.Schema:
    return pa.schema(
        [("query_key", query_type), (key, corpus.field(key).type), ("raw_similarity", pa.float64())]
        + [(n, corpus.field(n).type) for n in names]
    )


def _blocks(rows: int | Column, block_rows: int, fewest: int) -> Column:
    """Blocks of ``block_rows``, unless that makes more than ``fewest``: every row meets all blocks of the other side, so then they
    are wider."""
    count = F.lit(rows) if isinstance(rows, int) else rows
    blocks = lambda size: F.ceil(count / F.lit(size))
    wider = F.greatest(F.lit(fewest), blocks(max(block_rows, WIDE_BLOCK_ROWS)))
    return F.greatest(F.lit(1), F.least(blocks(block_rows), wider).cast("int"))


def _with_block_counts(
    queries: DataFrame, corpus: DataFrame, cells: DataFrame, block_rows: int, fewest: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block counts of their cell; cells found on one side only drop out.

    ``cells`` has the ``cell`` of every corpus row and need not read a vector. The table of counts has one row per cell.
    """
    size = F.count(F.lit(1)).alias("n")
    q = queries.groupBy("cell").agg(size).select("cell", _blocks(F.col("n"), block_rows, fewest).alias("q_blocks"))
    c = cells.groupBy("cell").agg(size).select("cell", _blocks(F.col("n"), block_rows, fewest).alias("c_blocks"))
    counts, _ = staged_keys(q.join(c, "cell"))
    return queries.join(counts, "cell"), corpus.join(counts, "cell")


def _block_join(
    queries: DataFrame, corpus: DataFrame, k: int, key: str, payload: Sequence[str], fields: T.StructType
) -> DataFrame:
    """Top ``k`` per query and block pair, for queries and corpus rows of the same ``cell``.

    Both sides carry the block counts of their cell, ``q_blocks`` and ``c_blocks``. Rows go to a block of their own
    side by key hash, and to every block of the other side.
    """

    def cut(df: DataFrame, key_: Column, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key_), F.col(f"{own}s").cast("long")).cast("int")
        return (
            df.withColumn(own, block)
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .drop("q_blocks", "c_blocks")
        )

    q = cut(queries, F.col("query_key"), "q_block", "c_block")
    c = cut(corpus, F.col(key), "c_block", "q_block")
    names = list(payload)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        query_type = left.schema.field("query_key").type
        schema = _schema(query_type, right.schema, key, names)
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        best = _Best(_matrix(left["query_vector"], None), k)
        units = _matrix(right["_vector"], best.queries.shape[1])
        best.add(right[key].combine_chunks(), units, [right[n].combine_chunks() for n in names], names)
        return pa.Table.from_batches(best.batches(left["query_key"].combine_chunks(), schema, names), schema)

    on = ["cell", "q_block", "c_block"]
    return q.groupBy(*on).cogroup(c.groupBy(*on)).applyInArrow(meet, fields)


class CellIndex:
    """Cells of similar vectors, found by k-means. The centres go to every task, so their size is bounded.

    Cells are numbered as the centres are, unless ``ids`` gives them other numbers.
    """

    def __init__(self, centres: np.ndarray, ids: Sequence[int] | None = None):
        if centres.size * 8 > CENTRE_BYTES:
            raise ValueError(f"{len(centres)} centres of {centres.shape[1]} numbers exceed {CENTRE_BYTES} bytes; use fewer cells")
        self.centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        self.ids = np.arange(len(centres), dtype=np.int32) if ids is None else np.asarray(ids, np.int32)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("errorifexists").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CellIndex":
        stored = spark.read.schema("cell int, centre array<double>").parquet(path)
        numbers = stored.agg(F.sum(F.size("centre"))).head()[0] or 0
        if numbers * 8 > CENTRE_BYTES:
            raise ValueError(f"the index at {path} holds {numbers} numbers, more than {CENTRE_BYTES} bytes")
        return cls(np.array([r.centre for r in stored.orderBy("cell").collect()]))

    @classmethod
    def fit(
        cls, corpus: DataFrame, cells: int, *, key: str = "issue_key", vector: str = "embedding",
        rows_per_cell: int | None = None, seed: int = 42,
    ) -> "CellIndex":
        """Centres of all searchable rows, or, with ``rows_per_cell``, of a hash-chosen part of so many rows a cell."""
        rows = searchable(corpus, vector)
        if rows_per_cell is not None:
            share = min(1.0, cells * rows_per_cell / max(1, rows.count()))
            place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
            rows = rows.filter(place < F.lit(int(share * (1 << 40))))
        chosen = rows.select(unit(F.col(vector)).alias("_unit"))
        training = durable(chosen).select(array_to_vector("_unit").alias("features"))  # read once per iteration
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(training)
        return cls(np.array(model.clusterCenters()))

    def usual_probes(self) -> int:
        return max(4, math.ceil(PROBED_SHARE * len(self.centres)))

    def assign(self, df: DataFrame, vector: str, nearest_cells: int = 1) -> DataFrame:
        """Each row once per cell among its ``nearest_cells`` closest, in a column ``cell``."""
        sent = df.sparkSession.sparkContext.broadcast((self.centres, self.ids))
        take = max(1, min(nearest_cells, len(self.centres)))
        fields = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, ids = sent.value
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                sims = _matrix(batch.column(vector), centres.shape[1]) @ centres.T
                cells = ids[np.argsort(-sims, axis=1, kind="stable")[:, :take]]
                again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), take)))
                names = [*batch.schema.names, "cell"]
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cells.ravel())], names=names)

        return df.mapInArrow(place, fields)


def approximate_neighbours(
    queries: DataFrame, corpus: DataFrame, index: CellIndex, k: int = DEFAULT_NEIGHBOURS, probes: int | None = None, *,
    query_key: str = "query_key", query_vector: str = "query_vector", key: str = "issue_key",
    vector: str = "embedding", payload: Sequence[str] = ("story_points",), fetch: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Nearest corpus rows within the ``probes`` cells closest to each query, exactly ranked there.

    By default three quarters of the cells are searched, at least four; how many neighbours that finds is told by ``recall``.
    With as many probes as cells the result is that of ``nearest``. A corpus that is searched often is better
    stored with its ``cell`` (``write_vectors`` with an index), which is then used as it is: where the table is
    partitioned by it, only the probed cells are read.
    """
    k = max(1, k)
    probes = index.usual_probes() if probes is None else probes
    q = searchable(queries, query_vector).select(F.col(query_key).alias("query_key"), F.col(query_vector).alias("query_vector"))
    placed = searchable(corpus, vector)
    probed = durable(index.assign(q, "query_vector", probes))
    if "cell" in corpus.columns:
        cells = [r[0] for r in probed.select("cell").distinct().collect()]  # at most as many as centres
        placed, sized = placed.filter(F.col("cell").isin(cells)), corpus.filter(F.col("cell").isin(cells)).select("cell")
    else:
        placed = index.assign(placed, vector)
        sized = placed.select("cell")
    c = placed.select(key, F.col(vector).alias("_vector"), *payload, "cell")
    fields = _output(q, c, "query_key", key, payload)
    found = _rank(_block_join(*_with_block_counts(probed, c, sized, block_rows), k, key, payload, fields), key, k)
    return with_columns_of(found, corpus, key, fetch) if fetch else found


def recall(found: DataFrame, exact: DataFrame, key: str = "issue_key") -> DataFrame:
    """Share of the exact neighbours that were found, one row."""
    hits = exact.select("query_key", key).join(
        found.select("query_key", key, F.lit(1).alias("hit")), ["query_key", key], "left"
    )
    return hits.agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"),
        F.avg(F.coalesce("hit", F.lit(0))).alias("recall"),
    )


def with_columns_of(neighbours: DataFrame, corpus: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Neighbours with further columns of the corpus rows they name."""
    return corpus.select(key, *columns).join(neighbours, key)


def ranked_list(columns: Sequence[str]) -> Column:
    """Aggregate: a query's neighbours in rank order, at most ``k`` of the search."""
    items = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    return F.transform(items, lambda t: F.struct(*[t[c].alias(c) for c in columns]))


def as_lists(neighbours: DataFrame, columns: Sequence[str] = ("issue_key", "story_points", "similarity")) -> DataFrame:
    """One row per query with its neighbours as a list."""
    return neighbours.groupBy("query_key").agg(ranked_list(columns).alias("similar_tickets"))
