"""Vectors compressed to four byte codes by product quantisation in exact integers, over Hilbert-sorted flat blocks.

Components become whole numbers, ``floor(1024 x)``, and vectors are cut into four equal parts. The parts of one position are
ordered along a Hilbert curve and packed into flat blocks of neighbours, each with the smallest and largest value of every
component (its box), the sum of its rows and their number. A round then takes a block at a time: an entry of the codebook whose
least distance to the box exceeds the largest distance of another entry can be nearest to no row of the block, so only a
shortlist is compared with the rows, in exact integers; where one entry is left, the stored sum stands for all rows. Codebooks
are bounded (four times ``ENTRIES`` rows) and go to every task; sums come back combined, at most one row per entry.

Codebooks start as the parts of the rows with the smallest ``vec_id``; ties in distance go to the lower entry, sums are divided
rounding down, and entries that nothing is assigned to stay.

Rows whose vector is null or holds null, NaN or an infinity are dropped. All other vectors must be of one length that four
divides, and no component beyond 131,072 (2**17), so that every distance fits 64 bits; else an error says so. A null ``vec_id``
comes after all others; rows that repeat a ``vec_id`` are ordered by their vectors, and each keeps its row and its weight in the
sums. Fewer than ``ENTRIES`` rows make as many entries. Null labels are one group. An empty table, or one without a usable
vector, gives an empty result; vectors without components all get code 0. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from storygauge.llm.common import durable, small_side, staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 128
LARGEST = 1 << 27  # of a whole-number component
_KEY_BITS = 60
_EXACT = 1 << 53  # whole numbers up to here are exact in a double


@dataclass(frozen=True)
class Codes:
    """The coded rows ``vec_id, label, code, error`` and the final codebooks, an array (part, entry, component)."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Staged rows ``row, vec_id, label, v`` of the usable vectors, their components as whole numbers."""
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    floor = lambda c: F.floor(c.cast("double") * SCALE)
    far = F.raise_error(F.lit(f"vectors to be coded must not hold components beyond {LARGEST // SCALE}")).cast("int")
    bounded = lambda c: F.when(F.abs(c.cast("double")) * SCALE > LARGEST, far).otherwise(floor(c).cast("int"))
    return durable(vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label",
        F.transform(x, bounded).alias("v"),
    ))


# --- the curve -------------------------------------------------------------------------------------
def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points with coordinates below ``2**bits``, as whole numbers of ``bits`` a dimension."""
    x = [np.ascontiguousarray(c, dtype=np.int64) for c in points.T]
    if not x:
        return np.zeros(len(points), np.int64)
    step = 1 << (bits - 1)
    while step > 1:  # undo the turns of each level, from the coarsest
        low = step - 1
        for i in range(len(x)):
            turned = (x[i] & step) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        step >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    parity, step = np.zeros(len(points), np.int64), 1 << (bits - 1)
    while step > 1:
        parity ^= np.where(x[-1] & step, step - 1, 0)
        step >>= 1
    key = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ parity) >> bit) & 1)
    return key


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(column), width)


def _keyed(width: int, least: int, most: int):
    """Each row's parts with their places on the curve: ``part, place, row, v``."""
    size = width // PARTS
    used = min(size, _KEY_BITS)
    bits = max(1, min(16, _KEY_BITS // max(1, used)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_parts, rows = _matrix(batch.column("v"), width), batch.column("row")
            for part in range(PARTS):
                own = np.ascontiguousarray(all_parts[:, part * size:(part + 1) * size])
                grid = (own[:, :used].astype(np.int64) - least) * (1 << bits) // (most - least + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), part, np.int32)), pa.array(hilbert_keys(grid, bits)), rows,
                     pa.array([r.tobytes() for r in own], pa.binary())], names=["part", "place", "row", "v"])

    return run


# --- flat blocks -----------------------------------------------------------------------------------
def _packed(size: int):
    """Rows in the order of the curve as blocks ``part, n, rows, v, low, high, total``, all but the first two as plain bytes."""

    def block(part: int, rows: np.ndarray, data: bytes) -> list:
        v = np.frombuffer(data, np.int32).reshape(len(rows), size)
        return [part, len(rows), rows.tobytes(), data, v.min(0).tobytes(), v.max(0).tobytes(), v.sum(0, dtype=np.int64).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, data = -1, [], []

        def flush() -> list[list]:
            made = [block(part, np.array(rows[i:i + BLOCK_ROWS], np.int64), b"".join(data[i:i + BLOCK_ROWS]))
                    for i in range(0, len(rows), BLOCK_ROWS)]
            rows.clear()
            data.clear()
            return made

        def sent(made: list[list]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["part", "n", "rows", "v", "low", "high", "total"])

        for batch in batches:
            made = []
            for p, row, v in zip(batch.column("part").to_pylist(), batch.column("row").to_pylist(), batch.column("v").to_pylist()):
                if p != part or len(rows) == BLOCK_ROWS:
                    made += flush()
                    part = p
                rows.append(row)
                data.append(v)
            if made:
                yield sent(made)
        if rows:
            yield sent(flush())

    return run


def flat_blocks(whole: DataFrame, width: int, least: int, most: int) -> DataFrame:
    """The staged blocks of all parts. Equal vectors are told apart by their rows, so no crowd of copies meets in one task."""
    keyed = whole.select("row", "v").mapInArrow(_keyed(width, least, most), "part int, place long, row long, v binary")
    ordered = keyed.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    fields = "part int, n int, rows binary, v binary, low binary, high binary, total binary"
    return durable(ordered.mapInArrow(_packed(width // PARTS), fields))


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to a row of the box: whose least distance to it no entry's largest distance falls below."""
    below, above = entries - low, entries - high
    nearest = np.where(below < 0, below, np.where(above > 0, above, 0))
    farthest = np.maximum(np.abs(below), np.abs(above))
    return np.flatnonzero((nearest * nearest).sum(1) <= (farthest * farthest).sum(1).min())


def distances(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: by one matrix product where doubles hold every term."""
    largest = max(1, int(np.abs(v).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * largest * largest * max(1, v.shape[1]) < _EXACT:
        a, b = v.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return np.stack([((v - e) ** 2).sum(1) for e in entries], 1)


class _Blocks:
    """Reads blocks and gives each one's codes and distances; ``whole`` where one entry takes all its rows."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks, self.size = codebooks, codebooks.shape[2]

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray]]:
        names = ("part", "n", "v", "low", "high")
        for i, (part, n, v, low, high) in enumerate(zip(*[batch.column(c).to_pylist() for c in names])):
            box = [np.frombuffer(b, np.int32).astype(np.int64) for b in (low, high)]
            yield part, i, np.frombuffer(v, np.int32).reshape(n, self.size), shortlist(*box, self.codebooks[part])

    def nearest(self, part: int, v: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = distances(v.astype(np.int64), self.codebooks[part][some])
        best = found.argmin(1)  # the first of equals
        return some[best], found[np.arange(len(v)), best].astype(np.int64)


def _sums(codebooks: np.ndarray):
    """One round's sums by entry: ``part, entry, n, total``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(codebooks)
        totals, counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            stored = batch.column("total").to_pylist()
            for part, i, v, some in blocks.read(batch):
                if len(some) == 1:
                    totals[part, some[0]] += np.frombuffer(stored[i], np.int64)
                    counts[part, some[0]] += len(v)
                else:
                    codes, _ = blocks.nearest(part, v, some)
                    np.add.at(totals[part], codes, v)
                    counts[part] += np.bincount(codes, minlength=codebooks.shape[1])
        part, entry = np.nonzero(counts)
        if len(part):
            lists = pa.array([t.tolist() for t in totals[part, entry]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), lists],
                names=["part", "entry", "n", "total"])

    return run


def _assigned(codebooks: np.ndarray):
    """Every row's code of one part and its distance: ``row, code, error``, the code at its place among all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(codebooks)
        for batch in batches:
            rows = batch.column("rows").to_pylist()
            for part, i, v, some in blocks.read(batch):
                codes, error = blocks.nearest(part, v, some)
                placed = codes.astype(np.int64) << (8 * (PARTS - 1 - part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(rows[i], np.int64)), pa.array(placed), pa.array(error)], names=["row", "code", "error"])

    return run


def updated(codebooks: np.ndarray, blocks: DataFrame) -> np.ndarray:
    """The codebooks after one round; at most one row per entry reaches the driver."""
    size = codebooks.shape[2]
    summed = blocks.mapInArrow(_sums(codebooks), "part int, entry int, n long, total array<long>")
    parts = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)]
    new = codebooks.copy()
    for r in summed.groupBy("part", "entry").agg(F.sum("n").alias("n"), *parts).collect():
        new[r["part"], r["entry"]] = np.array([r[f"t{i}"] // r["n"] for i in range(size)], np.int64)
    return new


def compress(vectors: DataFrame, vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all usable rows ``vec_id, label, code, error``, and the codebooks they refer to."""
    whole = whole_vectors(vectors, vector)
    size = F.size("v")
    rows, shortest, longest, least, most = whole.agg(
        F.count(F.lit(1)), F.min(size), F.max(size), F.min(F.array_min("v")), F.max(F.array_max("v"))).head()
    if not rows:
        return Codes(whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64))
    if shortest != longest or longest % PARTS:
        raise ValueError(f"vectors of {shortest} to {longest} components cannot be cut into {PARTS} equal parts")
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, longest // PARTS)
    codebooks = np.ascontiguousarray(start.transpose(1, 0, 2))
    blocks = flat_blocks(whole, longest, least or 0, most or 0)
    for _ in range(rounds):
        codebooks = updated(codebooks, blocks)
    assigned = blocks.mapInArrow(_assigned(codebooks), "row long, code long, error long")
    coded = assigned.groupBy("row").agg(F.sum("code").alias("code"), F.sum("error").alias("error"))
    code = F.lower(F.lpad(F.hex("code"), 2 * PARTS, "0")).alias("code")
    return Codes(coded.join(whole.select("row", "vec_id", "label"), "row").select("vec_id", "label", code, "error"), codebooks)


def with_label_errors(codes: Codes) -> DataFrame:
    """The rows with the error summed over their label and the codebooks' digest."""
    rows = durable(codes.rows)
    summed, labels = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    named = summed.select(F.col("label").alias("_label"), "label_error")
    joined = rows.join(small_side(named, labels), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
