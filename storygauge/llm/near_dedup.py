"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, weight = occurrences x idf. The idf is smoothed and saturates:
``2 + ln(N / df) / ln(1 / RARE)``, where a shingle in fewer than one of 1,000 documents counts as one in that many. Only
the frequent shingles need a list, whose length is bounded by the mean number of shingles over ``RARE``.

``SAMPLES`` consistent weighted samples a text are cut into bands of four; texts that share a band are candidates, and a
link is a weighted Jaccard similarity of 0.8 or more, always computed from the whole texts. A class is a connected
component of links. No list of pairs is ever made:

* texts with equal words are one node from the start;
* every node of a band's bucket is compared with the bucket's pivot, the node that meets most others;
* what this leaves open, nodes that are no link of the pivot against the rest of their bucket, is compared in blocks of
  bounded size as one matrix product each, from which only links between classes that were apart come out. Nodes that the
  triangle inequality of the Jaccard distance rules out are left aside.

A null text counts as empty; texts without words are one class. Null ids come last. Rows that repeat id and text are
members like others. Very long texts are compared whole. An empty table gives an empty result; other columns are carried through
or not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from storygauge.llm import shingles
from storygauge.llm.common import durable, per_process, small_batches, small_side, staged, texts

THRESHOLD = 0.8
SAMPLES, ROWS = 64, 4
RARE = 1e-3
MOST_FREQUENT = 1 << 20  # entries of the list of frequent shingles; where there are more, "rare" begins higher
TABLE = 1 << 12
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 768  # texts of one side of a block, about
RUN = 1 << 20  # shingle hashes that a task sorts and counts at once
FEATURES_AT_ONCE = 1 << 12


def _texts_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    for hashes, digest in shingles.of_texts(column):
        found, counts = np.unique(hashes, return_counts=True)
        yield found, counts, digest


# --- document frequencies --------------------------------------------------------------------------
def _counted(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order with their summed counts."""
    if not len(hashes):
        return hashes, np.empty(0, np.int64)
    order = None if counts is None else np.argsort(hashes, kind="stable")
    ordered = np.sort(hashes) if order is None else hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if counts is None:
        return ordered[first], np.diff(np.append(first, len(ordered)))
    return ordered[first], np.add.reduceat(counts[order], first)


def first_cut(total: int) -> int:
    return max(2, math.ceil(RARE * total))


def frequent_shingles(docs: DataFrame, total: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and document frequencies of all shingles from the cut on, and the cut.

    Tasks send each block of hash values as one sorted run, a counted hash only once a run, so that hot shingles combine
    before the shuffle; a block of hash values holds about a million hashes, whatever the input.
    """
    bits = min(30, max(6, math.ceil(math.log2(max(1.0, size / 6 / (1 << 20))))))
    cut = first_cut(total)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def flushed() -> pa.RecordBatch:
            found, counts = _counted(np.concatenate(held))
            block = (found >> np.uint64(64 - bits)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                h, c = found[a:b], counts[a:b]
                often = c > 1
                rows.append((int(block[a]), h[~often].tobytes(), h[often].tobytes(), c[often].astype("<i8").tobytes()))
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["block", "once", "often", "times"])

        for batch in batches:
            for found, _, _ in _texts_of(batch.column(0)):
                held.append(found)
                many += len(found)
                if many >= RUN:
                    yield flushed()
                    held, many = [], 0
        if many:
            yield flushed()

    def summed(table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table.column("once").to_pylist()), np.uint64)
        often = np.frombuffer(b"".join(table.column("often").to_pylist()), np.uint64)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), "<i8")
        found, counts = _counted(np.concatenate((once, often)), np.concatenate((np.ones(len(once), np.int64), times)))
        kept = counts >= cut
        return pa.table({"shingle": pa.array(found[kept].view(np.int64)), "df": pa.array(counts[kept], pa.int64())})

    schema = "block long, once binary, often binary, times binary"
    frequent, count = staged(
        texts(docs).select("text").mapInArrow(runs, schema).groupBy("block").applyInArrow(summed, "shingle long, df long"))
    while count > MOST_FREQUENT:
        cut *= 2
        count = frequent.filter(F.col("df") >= cut).count()
    listed = frequent.filter(F.col("df") >= cut).toArrow()
    hashes, df = listed.column("shingle").to_numpy().view(np.uint64), listed.column("df").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], df[order], cut


class Weights:
    """The idf of shingles: a sorted list of the frequent ones, one value for all others."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, total: int, cut: int = 0):
        span, floor = math.log(1 / RARE), max(1.0, RARE * total)
        if cut > first_cut(total):  # the list was too long: all that is not on it counts as frequent as its rarest
            floor = float(cut)
        self.rare = np.float32(2 + math.log(max(1.0, total / floor)) / span)
        self.hashes = hashes
        self.idf = (2 + np.log(np.maximum(1.0, total / np.maximum(df, floor))) / span).astype(np.float32)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes & np.uint64((1 << 20) - 1)] = True

    def of(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(found), self.rare, np.float32)
        maybe = np.flatnonzero(self.seen[found & np.uint64((1 << 20) - 1)])
        if len(maybe) and len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, found[maybe]), len(self.hashes) - 1)
            hit = self.hashes[place] == found[maybe]
            out[maybe[hit]] = self.idf[place[hit]]
        return out


# --- sampling --------------------------------------------------------------------------------------
class Sampler:
    """Improved consistent weighted sampling. A shingle's random numbers come from three tables by bits of its hash."""

    def __init__(self, samples: int = SAMPLES, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.r = draw.gamma(2, 1, (TABLE, samples)).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, (TABLE, samples))).astype(np.float32)
        self.beta = draw.uniform(0, 1, (TABLE, samples)).astype(np.float32)
        self.samples = samples

    def codes(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each sample a code of the chosen shingle and its quantised weight."""
        best, chosen, level = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.float32)
        every, mask = np.arange(self.samples), np.uint64(TABLE - 1)
        for a in range(0, len(found), 1024):
            h, w = found[a:a + 1024], np.log(weights[a:a + 1024])[:, None]
            r, beta = self.r[h & mask], self.beta[(h >> np.uint64(12)) & mask]
            t = np.floor(w / r + beta)
            rank = self.log_c[(h >> np.uint64(24)) & mask] - r * (t - beta + 1)
            least = rank.argmin(axis=0)
            value = rank[least, every]
            better = value < best
            best[better], chosen[better], level[better] = value[better], h[least[better]], t[least[better], every[better]]
        return shingles.mixed(chosen + level.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def bands(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        codes = self.codes(found, weights).reshape(-1, ROWS)
        keys = np.zeros(len(codes), np.uint64)
        for i in range(ROWS):
            keys = shingles.mixed(keys * np.uint64(0xA0761D6478BD642F) + codes[:, i] + np.uint64(i))
        return keys.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, key`` (MD5 of the text), ``content`` (digest of its words), ``size`` in bytes, ``bands``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = per_process("sampler", Sampler)
        for batch in batches:
            content, bands = [], []
            for found, counts, digest in _texts_of(batch.column(2)):
                content.append(digest)
                bands.append(sampler.bands(found, counts * weights.of(found)) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(content, pa.binary()), batch.column(3), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "key", "content", "size", "bands"])

    rows = _keyed(docs).withColumn("size", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "doc_id long, key binary, content binary, size long, bands array<long>")


# --- comparing -------------------------------------------------------------------------------------
def weighted_jaccard(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Of two texts as (shingles in order, occurrences, idf)."""
    (x, cx, wx), (y, cy, wy) = a, b
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = float((np.minimum(cx[i], cy[j]) * wx[i]).sum())
    whole = float((cx * wx).sum()) + float((cy * wy).sum()) - shared
    return shared / whole if whole else 1.0


def similarities(pairs: DataFrame, weights: Weights) -> DataFrame:
    """``a, b, similarity`` of rows ``a, b, text_a, text_b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[(f, c, weights.of(f)) for f, c, _ in _texts_of(batch.column(i))] for i in (2, 3)]
            found = [weighted_jaccard(x, y) for x, y in zip(*sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def block_similarities(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Weighted Jaccard similarities of all texts of two lists, by products of incidence matrices.

    The minimum of two counts is the number of levels both reach, so each occurrence of a shingle is a feature of its own.
    """
    def entries(side: list[tuple]) -> tuple[np.ndarray, ...]:
        row = np.concatenate([np.repeat(i, c.sum()) for i, (_, c, _) in enumerate(side)])
        shingle = np.concatenate([np.repeat(f, c) for f, c, _ in side])
        weight = np.concatenate([np.repeat(w, c) for _, c, w in side]).astype(np.float32)
        level = np.concatenate([np.concatenate([np.arange(k) for k in c]) if c.max(initial=1) > 1 else np.zeros(len(c), np.int64) for _, c, _ in side])
        return row, shingles.mixed(shingle + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), weight

    (row_l, feature_l, weight_l), (row_r, feature_r, _) = entries(left), entries(right)
    common = np.intersect1d(feature_l, feature_r)
    shared = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(common), FEATURES_AT_ONCE):
        part = common[start:start + FEATURES_AT_ONCE]
        sides = []
        for row, feature, many in ((row_l, feature_l, len(left)), (row_r, feature_r, len(right))):
            place = np.minimum(np.searchsorted(part, feature), len(part) - 1)
            hit = part[place] == feature
            matrix = np.zeros((many, len(part)), np.float32)
            matrix[row[hit], place[hit]] = weight_l[hit] if feature is feature_l else 1.0
            sides.append(matrix)
        shared += sides[0] @ sides[1].T
    whole = np.array([(c * w).sum() for _, c, w in left])[:, None] + np.array([(c * w).sum() for _, c, w in right])[None, :]
    return shared / np.maximum(whole - shared, 1e-12)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component of ``a, b``.

    Every round takes the smallest root among neighbours and then the root's root; it ends when nothing changes.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = durable(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("_near"))
        least = durable(roots.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("_was"), F.least("root", "_near").alias("root")))
        jump = least.select(F.col("node").alias("root"), F.col("root").alias("_far"))
        moved, _ = staged(least.join(jump, "root", "left").select("node", "_was", F.least("root", F.coalesce("_far", "root")).alias("root")))
        roots = moved.select("node", "root")
        if moved.filter("_was <> root").isEmpty():
            return roots


class Classes:
    """Staged rows (``doc_id, key, content``) and, for every text that is not alone, ``content, root, class_id, class_size``.

    A class is told by its root, a content of its own; its smallest id is a label that several classes may share.
    """

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD):
        self.threshold = threshold
        small_batches(docs.sparkSession)
        source = texts(docs)
        total, size = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        hashes, df, cut = frequent_shingles(docs, total, size)
        self.weights = Weights(hashes, df, max(1, total), cut)
        signed = durable(signatures(docs, self.weights))
        self.rows = signed.select("doc_id", "key", "content", F.monotonically_increasing_id().alias("_row"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("_unnamed"), "doc_id"))
        self.nodes = durable(signed.groupBy("content").agg(
            F.count(F.lit(1)).alias("copies"), least["doc_id"].alias("least"), F.min("key").alias("key"), F.min("size").alias("size"),
            F.first("bands").alias("bands")))
        links = self._links(docs)
        roots = components(links)
        held = self.nodes.select("content", "copies", "least").join(roots.withColumnRenamed("node", "content"), "content", "left")
        held = held.filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "content"))
        whole = held.groupBy("root").agg(
            F.min(F.struct(F.col("least").isNull().alias("_unnamed"), "least")).alias("_l"), F.sum("copies").alias("class_size"))
        whole = durable(whole.select("root", F.col("_l.least").alias("class_id"), "class_size"))
        self.classes, self.count = staged(durable(held.select("content", "root")).join(whole, "root"))

    def _links(self, docs: DataFrame) -> DataFrame:
        """``a, b`` of links that connect all texts which a chain of links through shared buckets connects."""
        members = self.nodes.select("content", "size", F.posexplode("bands").alias("_band", "_code"))
        members = members.select("content", "size", F.xxhash64("_band", "_code").alias("bucket"))
        crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1")
        live = durable(members.join(crowded, "bucket"))
        meets = live.groupBy("content").agg(F.sum("_many").alias("_meets"))
        ranked = live.select("bucket", "content").join(meets, "content")
        pivots = durable(ranked.groupBy("bucket").agg(F.max(F.struct("_meets", "content"))["content"].alias("pivot")))
        against = durable(live.join(pivots, "bucket"))
        pairs = against.filter("content <> pivot").select(F.col("content").alias("a"), F.col("pivot").alias("b")).distinct()
        wanted, count = staged(self.nodes.select("content", "key").join(meets.select("content"), "content", "left_semi"))
        bodies = _keyed(docs).join(small_side(wanted.select("key"), count), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        bodies = durable(wanted.join(bodies, "key").select("content", "text"))
        sides = [bodies.withColumnsRenamed({"content": c, "text": f"text_{c}"}) for c in "ab"]
        compared = durable(similarities(pairs.join(sides[0], "a").join(sides[1], "b"), self.weights))
        links = compared.filter(F.col("similarity") >= self.threshold).select("a", "b")
        found = self._between(against, compared, components(links), bodies)
        return links if found is None else links.union(found)

    def _between(self, against: DataFrame, compared: DataFrame, roots: DataFrame, bodies: DataFrame) -> DataFrame | None:
        """Links inside buckets between classes that comparing with the pivot has left apart."""
        known = compared.withColumnsRenamed({"a": "content", "b": "pivot"})
        seen = against.filter("content <> pivot").join(known, ["content", "pivot"]).join(roots.withColumnRenamed("node", "content"), "content", "left")
        seen = seen.withColumn("root", F.coalesce("root", "content"))
        pivot_roots = roots.withColumnsRenamed({"node": "pivot", "root": "_pivot_root"})
        seen = seen.join(pivot_roots, "pivot", "left").withColumn("_pivot_root", F.coalesce("_pivot_root", "pivot"))
        # apart from the pivot's class; of the others, those linked to the pivot itself
        apart, direct = F.col("root") != F.col("_pivot_root"), F.col("similarity") >= self.threshold
        reach = 2 * self.threshold - 1  # a text farther from the pivot has no link to a link of the pivot
        seen = durable(seen.select("bucket", "content", "size", "root", apart.alias("apart"), (~apart & direct).alias("direct"),
                                   (apart & (F.col("similarity") >= reach)).alias("near")))
        number = lambda c: F.sum(F.when(c, 1).otherwise(0))
        counts = seen.groupBy("bucket").agg(
            number(F.col("apart")).alias("n_apart"), number(F.col("near")).alias("n_near"), number(F.col("direct")).alias("n_direct"),
            number(~F.col("apart") & ~F.col("direct")).alias("n_loose"),
            F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0)).alias("_left"),
            F.sum(F.when(~F.col("direct"), F.col("size")).otherwise(0)).alias("_right"), F.sum("size").alias("_all"))
        counts = counts.filter("n_apart > 1 or (n_apart = 1 and (n_loose > 0 or (n_near > 0 and n_direct > 0)))")
        blocks = lambda size, rows: F.greatest(F.ceil((size + 1) / BLOCK_BYTES), F.ceil((rows + 1) / BLOCK_ROWS)).cast("int")
        others = F.col("n_apart") + F.col("n_loose")
        right = F.when(F.col("n_near") > 0, blocks(F.col("_all"), others + F.col("n_direct"))).otherwise(blocks(F.col("_right"), others))
        counts, count = staged(counts.select(
            "bucket", (F.col("n_near") > 0).alias("_with_direct"), blocks(F.col("_left"), F.col("n_apart")).alias("_i"), right.alias("_j")))
        if not count:
            return None
        open_ = seen.join(small_side(counts, count), "bucket").filter("_with_direct or not direct")
        spot = F.xxhash64("content")
        left = open_.filter("apart").select("bucket", "content", "root", F.lit(0).alias("side"), F.pmod(spot, "_i").cast("int").alias("i"),
                                            F.explode(F.sequence(F.lit(0), F.col("_j") - 1)).alias("j"))
        right = open_.select("bucket", "content", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("_i") - 1)).alias("i"),
                             F.pmod(spot, "_j").cast("int").alias("j"))
        rows = left.union(right).join(bodies, "content").select("bucket", "i", "j", "side", "content", "root", "text")
        return durable(rows.groupBy("bucket", "i", "j").applyInArrow(self._linker(), "a binary, b binary"))

    def _linker(self):
        weights, threshold = self.weights, self.threshold

        def run(table: pa.Table) -> pa.Table:
            side = table.column("side").to_numpy()
            parts = [table.filter(pa.array(side == s)) for s in (0, 1)]
            out: list[tuple[bytes, bytes]] = []
            if all(p.num_rows for p in parts):
                names = [p.column("content").to_pylist() for p in parts]
                roots = [p.column("root").to_pylist() for p in parts]
                sets = [[(f, c, weights.of(f)) for chunk in p.column("text").chunks for f, c, _ in _texts_of(chunk)] for p in parts]
                parent: dict[bytes, bytes] = {}

                def top(x: bytes) -> bytes:
                    while x in parent:
                        x = parent[x]
                    return x

                for x, y in np.argwhere(block_similarities(*sets) >= threshold):
                    a, b = top(roots[0][x]), top(roots[1][y])
                    if a != b:
                        parent[a] = b
                        out.append((names[0][x], names[1][y]))
            return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})

        return run

    def matched(self, rows: DataFrame) -> DataFrame:
        """Rows with ``content`` and, unless their text is alone, ``root``, ``class_id`` and ``class_size``."""
        return rows.join(small_side(self.classes, self.count), "content", "left")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (smallest id of its class), ``class_size, kept``.

    One row of each class is kept: one with the smallest id, any of them where rows repeat it or have none.
    """
    found = Classes(docs, threshold)
    rows = found.matched(found.rows)
    named = rows.filter("class_size is not null").filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    firsts, count = staged(named.groupBy("root").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_first")))
    alone = F.col("class_size").isNull()
    return rows.join(small_side(firsts, count), "_row", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | F.col("_first").isNotNull()).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the smallest id of their class, with all their columns.

    Rows of one class that repeat that id are equal here; one of them stays, the first in the order of their JSON. Classes
    that share their smallest id, or have none, each keep a document. The texts are not shuffled while the table of classes is small enough to be sent.
    """
    found = Classes(docs, threshold)
    many = found.matched(found.rows.select("key", "content").distinct()).filter("class_size is not null")
    by_key, count = staged(many.select(F.col("key").alias("_key"), "root", "class_id"))
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("_key"),
        F.col("doc_id").cast("long").alias("_id"))
    sided = by_key.withColumn("_in", F.lit(True))
    kept = held.join(small_side(sided, count), "_key", "left").filter(F.col("_in").isNull() | F.col("_id").eqNullSafe(F.col("class_id")))
    firsts = found.matched(found.rows).filter("class_size is not null").filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    twice, repeats = staged(firsts.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("root"))
    if repeats:
        again = F.coalesce("_again", F.lit(False))
        marked = kept.join(small_side(twice.withColumn("_again", F.lit(True)), repeats), "root", "left")
        first = marked.filter(again).groupBy("root").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))  # combined before it is shuffled
        kept = marked.filter(~again).select("_doc").union(first.select("_doc"))
    return kept.select("_doc.*")
