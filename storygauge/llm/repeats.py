"""Long passages that occur twice: every string of 400 bytes that also starts elsewhere, found by prefix-free parsing.

A window is a string of ``length`` bytes within one text. A rolling hash of short grams triggers the cuts of the text: the
trigger of a window is the smallest hash among its first grams, so equal windows have equal triggers at equal places, and a text
falls into phrases, runs of windows with one trigger. All windows of a run contain its core, a string around the trigger whose
length and place do not depend on the run. So two equal windows always lie in runs of the same class: those of one core.

* The dictionary: runs are reduced to distinct contexts (a run's bytes and what its last window reaches). A class whose core
  occurs once is done, and of a class with a single context that occurs twice every window is repeated.
* The order: the contexts of a class differ in the phrase ahead of the core and in the parse that follows it. The phrases'
  suffixes are sorted from the core to the left, the parse's suffixes from the core to the right, both with the lengths that
  neighbours share. A window takes its place in the order of the corpus from the two ranks at its own lengths, so equal windows
  are neighbours there: no window is written out, and no position but those at the edges of repeats is looked at singly.

Cores and contexts are compared by two 64-bit hashes; the phrases and the parse around a core byte by byte. Work in one task is
bounded: a class with more than ``CROWD`` different contexts is settled window by window in a shuffle instead. Copies of a text
are looked at once. Nothing but counts reaches the driver.

A null text is empty. Texts below ``length`` bytes have no windows and stay whole. Very long texts are read in slices, whole.
Repeated rows are copies like any other and get equal results; null ids stay null. An empty table gives an empty result; other
columns are not read, and ``without_repeats`` carries them along.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from storygauge.llm.common import durable, name_folder, per_process, small_side, staged
from storygauge.llm.shingles import mixed, powers
from storygauge.session import shared_folder

LENGTH = 400
SLICE = 1 << 20  # bytes parsed at a time
CROWD = 1 << 17  # different contexts of one core that are put in order in one task
TOGETHER = 1 << 15  # contexts of all classes put in order at a time
_PLACE, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Shape:
    """Lengths that follow from the window's: the gram's, and the most windows that one run has."""

    length: int = LENGTH

    def __post_init__(self):
        if self.length < 2:
            raise ValueError("repeats are sought from a length of two bytes on")

    @property
    def gram(self) -> int:
        return min(16, max(1, self.length // 25))

    @property
    def stride(self) -> int:
        return max(1, min(128, (self.length - self.gram + 1) // 2))

    @property
    def core(self) -> int:
        return self.length + 1 - self.stride


@dataclass(frozen=True)
class Runs:
    """Runs of a chunk: its piece, the first and last window start in it, windows' places (``low`` to ``high``) and hashes."""

    piece: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray
    context: np.ndarray


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n - width + 1], behind[width - 1:n])


def parse(data: np.ndarray, bounds: np.ndarray, shape: Shape) -> Runs:
    """The runs of all pieces of a chunk; ``bounds`` are where each piece begins, and the chunk's end."""
    n, reach = len(data), 2 * shape.stride
    up, down = per_process("powers-of-slices", lambda: powers(SLICE + 4 * LENGTH))
    if len(up) <= n:
        up, down = powers(n)
    if n < shape.length:
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none, none, none, none)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
    grams = mixed((sums[shape.gram:] - sums[:-shape.gram]) * down[:n - shape.gram + 1])
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    trigger = (_smallest(ranked, reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n - shape.length + 1]
    ahead = trigger - np.arange(len(trigger))
    part = ahead >= shape.stride  # windows whose trigger is far ahead make a run of their own
    run = trigger * 2 + part
    for begin, end in zip(bounds[:-1], bounds[1:]):
        run[max(begin, end - shape.length + 1):end] = -1  # windows that would leave their piece
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    ends = np.concatenate((starts[1:], [len(run)])) - 1
    real = run[starts] >= 0
    first, last = starts[real], ends[real]
    far = part[first] * shape.stride
    centre = trigger[first] - far  # where the core begins
    low, high = centre - last, centre - first
    hashed = lambda a, b: (sums[b] - sums[a]) * down[a]
    core = mixed(hashed(centre, centre + shape.core) + part[first].astype(np.uint64) * _PLACE)
    size = (last + shape.length - first).astype(np.uint64)
    context = mixed(hashed(first, last + shape.length) + low.astype(np.uint64) * _PLACE + size * _SIZE)
    piece = np.searchsorted(bounds, first, "right") - 1
    return Runs(piece, first, last, low, high, core.view(np.int64), context.view(np.int64))


def pieces(texts: list[bytes], shape: Shape) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Chunks of about ``SLICE`` bytes: for each piece its text and where it begins there; the bytes; the pieces' bounds.

    A text beyond a slice is cut in pieces that share all but one byte of a window, so each window is in exactly one.
    """
    names, held, size = [], [], 0

    def chunk():
        bounds = np.concatenate(([0], np.cumsum([len(h) for h in held])))
        return list(names), np.frombuffer(b"".join(held), np.uint8), bounds

    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - shape.length + 1), SLICE):
            piece = text[at:at + SLICE + shape.length - 1] if len(text) > SLICE else text
            if size and size + len(piece) > SLICE:
                yield chunk()
                names, held, size = [], [], 0
            names.append((row, at))
            held.append(piece)
            size += len(piece)
    if held:
        yield chunk()


def _distinct_runs(shape: Shape):
    """Rows ``tid, core, context, at, low, high, n``: each context of a text once, with its first place and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids = batch.column("tid")
            for names, data, bounds in pieces(batch.column("body").to_pylist(), shape):
                runs = parse(data, bounds, shape)
                if not len(runs.first):
                    continue
                row, base = (np.array(x) for x in zip(*names))
                text, at = row[runs.piece], runs.first - bounds[runs.piece] + base[runs.piece]
                order = np.lexsort((at, runs.context, runs.core, text))
                keys = [x[order] for x in (text, runs.core, runs.context)]
                new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
                chosen, counts = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
                yield pa.RecordBatch.from_arrays(
                    [tids.take(pa.array(text[chosen])), pa.array(runs.core[chosen]), pa.array(runs.context[chosen]),
                     pa.array(at[chosen]), pa.array(runs.low[chosen].astype(np.int32)), pa.array(runs.high[chosen].astype(np.int32)),
                     pa.array(counts)], names=["tid", "core", "context", "at", "low", "high", "n"])

    return run


# --- the order of a class --------------------------------------------------------------------------
def _sorted_suffixes(arms: list[bytes], width: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of arms within their classes, and how many bytes each shares with the one before (-1: another class)."""
    table = np.frombuffer(b"".join(a.ljust(width, b"\0") for a in arms), np.uint8).reshape(len(arms), width)
    keyed = np.concatenate([classes.astype(">u4").view(np.uint8).reshape(-1, 4), table], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 4}").ravel(), kind="stable")
    table, classes = table[order], classes[order]
    shared = np.cumprod(table[1:] == table[:-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    shared[classes[1:] != classes[:-1]] = -1
    return order, np.concatenate(([-1], shared))


def repeated_windows(
    classes: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes], right: list[bytes], stride: int
) -> np.ndarray:
    """For each context (rows) and place of a window (columns) whether another context of its class has the same window.

    The window at place ``u`` has ``u`` bytes ahead of the core and ``stride - 1 - u`` after it.
    """
    width, n = stride - 1, len(classes)
    by_left, same_left = _sorted_suffixes([a[::-1] for a in left], width, classes)
    by_right, same_right = _sorted_suffixes(right, width, classes)
    rank_left, rank_right = np.empty(n, np.int64), np.empty(n, np.int64)
    found = np.zeros((n, stride), bool)
    for u in range(stride):
        some = np.flatnonzero((low <= u) & (u <= high))
        if len(some) < 2:
            continue
        rank_left[by_left] = np.cumsum(same_left < u)
        rank_right[by_right] = np.cumsum(same_right < width - u)
        place = rank_left[some] * np.int64(n + 1) + rank_right[some]
        order = np.argsort(place, kind="stable")
        equal = place[order][1:] == place[order][:-1]
        twice = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        found[some[order[twice]], u] = True
    return found


def _in_order(shape: Shape):
    """Reads contexts sorted by core and returns their masks: ``core, context, mask``, one bit a place in bytes."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        core = rows["core"].to_numpy()
        classes = np.cumsum(np.concatenate(([0], (core[1:] != core[:-1]).astype(np.int64))))
        low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
        found = repeated_windows(classes, low, high, rows["left"].to_pylist(), rows["right"].to_pylist(), shape.stride)
        found |= rows["n"].to_numpy()[:, None] > 1
        masks = pa.array([m.tobytes() for m in np.packbits(found, axis=1)], pa.binary())
        some = pa.array(found.any(1))
        whole = pa.RecordBatch.from_arrays(
            [rows["core"].combine_chunks(), rows["context"].combine_chunks(), masks], names=["core", "context", "mask"])
        return whole.filter(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows > TOGETHER:
                core = held["core"].to_numpy()
                cut = int(np.searchsorted(core, core[-1]))  # the last class may go on
                if cut:
                    yield settle(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield settle(held)

    return run


def _window_by_window(crowded: DataFrame, shape: Shape) -> DataFrame:
    """The same masks for classes of too many contexts: every window by its digest, counted in a shuffle."""
    u = F.col("u")
    digest = F.unhex(F.md5(F.concat(F.expr("substring(left, high - u + 1, u)"), F.expr(f"substring(right, 1, {shape.stride - 1} - u)"))))
    windows = crowded.withColumn("u", F.explode(F.sequence("low", "high"))).select("core", "context", "n", "u", digest.alias("window"))
    counted = windows.groupBy("core", "u", "window").agg(F.sum("n").alias("times")).filter("times > 1")
    again = windows.join(counted, ["core", "u", "window"], "left_semi").groupBy("core", "context").agg(F.collect_set("u").alias("us"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(8 * (-(-shape.stride // 8)) - 1)), lambda i: F.when(F.array_contains("us", i), "1").otherwise("0"))
    joined = F.array_join(bits, "")
    hexed = F.concat(*[
        F.lpad(F.conv(F.substring(joined, 8 * i + 1, 8), 2, 16), 2, "0") for i in range(-(-shape.stride // 8))
    ])
    return again.select("core", "context", F.unhex(hexed).alias("mask"))


# --- the whole -------------------------------------------------------------------------------------
def _bodies(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.unhex(F.md5(body)).alias("tid"), body.alias("body"))


class _Stage:
    """Tables written below one folder of the shared one, removed together when they are no longer read."""

    def __init__(self, spark: SparkSession):
        name_folder(spark)
        self.spark, self.folder = spark, f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _texts_of(docs: DataFrame, tids: DataFrame, rows: int) -> DataFrame:
    """One copy of each text named, ``tid, body``; copies are merged before they are shuffled."""
    some = _bodies(docs).join(small_side(tids.select("tid"), rows), "tid", "left_semi")
    return some.groupBy("tid").agg(F.any_value("body").alias("body"))


def _marks(docs: DataFrame, shape: Shape, crowd: int) -> tuple[DataFrame, int]:
    """For each text with repeats its repeated contexts ``tid, marks (core, context, mask)``, and how many texts there are.

    A mask has a bit for each place of a window; null stands for all.
    """
    stage = _Stage(docs.sparkSession)
    fields = "tid binary, core long, context long, at long, low int, high int, n long"
    found = _bodies(docs).mapInArrow(_distinct_runs(shape), fields)
    runs = stage.write(found.groupBy("tid", "core", "context").agg(
        F.min("at").alias("at"), F.min("low").alias("low"), F.min("high").alias("high"), F.sum("n").alias("n")), "runs")
    classes = runs.groupBy("core").agg(F.sum("n").alias("times"), (F.min("context") != F.max("context")).alias("several"))
    again = stage.write(runs.join(classes.filter("times > 1").select("core", "several"), "core"), "again")

    # where contexts of a class differ: one of each, with the bytes around its core
    one = F.min(F.struct("tid", "at", "low", "high")).alias("one")
    contexts = again.filter("several").groupBy("core", "context").agg(F.sum("n").alias("n"), one)
    place = F.struct("core", "context", "n", "one.at", "one.low", "one.high")
    wanted, texts = staged(contexts.groupBy("one.tid").agg(F.collect_list(place).alias("places")))
    arms = _texts_of(docs, wanted, texts).join(wanted, "tid").select(F.explode(F.transform("places", lambda p: F.struct(
        p["core"].alias("core"), p["context"].alias("context"), p["n"].alias("n"), p["low"].alias("low"), p["high"].alias("high"),
        F.substr("body", (p["at"] + 1).cast("int"), p["high"]).alias("left"),
        F.substr("body", (p["at"] + p["high"] + shape.core + 1).cast("int"), F.lit(shape.stride - 1) - p["low"]).alias("right"),
    ))).alias("c")).select("c.*")
    arms = stage.write(arms, "arms")
    crowds, number = staged(arms.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowd).select("core"))
    usual = arms.join(small_side(crowds, number), "core", "left_anti") if number else arms
    sorted_arms = usual.repartition("core").sortWithinPartitions("core", "context")
    masks = sorted_arms.mapInArrow(_in_order(shape), "core long, context long, mask binary")
    if number:
        masks = masks.unionByName(_window_by_window(arms.join(small_side(crowds, number), "core", "left_semi"), shape))

    alike = again.filter("NOT several").select("tid", "core", "context", F.lit(None).cast("binary").alias("mask"))
    partly = again.filter("several").select("tid", "core", "context").join(masks, ["core", "context"])
    marks = alike.unionByName(partly).groupBy("tid").agg(F.collect_list(F.struct("core", "context", "mask")).alias("marks"))
    kept, texts = staged(marks)  # no more of a text than its own runs
    stage.remove()
    return kept, texts


def _starts(runs: Runs, at: int, marked: dict, shape: Shape) -> np.ndarray:
    """First and last window starts of all stretches of repeated windows among one piece's runs, counted from ``at``."""
    found = []
    for first, last, high, core, context in zip(runs.first, runs.last, runs.high, runs.core.tolist(), runs.context.tolist()):
        if (core, context) not in marked:
            continue
        mask = marked[core, context]
        if mask is None:
            found.append((first, last))
            continue
        bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=shape.stride)
        own = np.concatenate(([0], bits[high - np.arange(last - first + 1)], [0])).astype(np.int8)  # in the order of the text
        edges = np.flatnonzero(np.diff(own))
        found += list(zip(first + edges[::2], first + edges[1::2] - 1))
    return np.array(found, np.int64).reshape(-1, 2) + at


def spans_of(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """The maximal stretches of bytes that windows starting in the given stretches cover, as (start, stop)."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    begin, end = starts[:, 0], starts[:, 1] + length
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return np.stack([begin[new], reach[np.append(new[1:], len(begin)) - 1]], 1)


def _cut(shape: Shape):
    """Texts with their marks to ``tid, spans, kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            marked = [{(m["core"], m["context"]): m["mask"] for m in marks} for marks in batch.column("marks").to_pylist()]
            starts: list[list] = [[] for _ in bodies]
            for names, data, bounds in pieces(bodies, shape):
                runs = parse(data, bounds, shape)
                edges = np.searchsorted(runs.piece, np.arange(len(names) + 1))
                for i, (row, base) in enumerate(names):
                    a, b = edges[i], edges[i + 1]
                    own = Runs(*[getattr(runs, f)[a:b] for f in Runs.__dataclass_fields__])
                    starts[row].append(_starts(own, base - bounds[i], marked[row], shape))
            spans = [spans_of(np.concatenate(s), len(b), shape.length) for s, b in zip(starts, bodies)]
            kept = [b"".join(b[x:y] for x, y in zip([0, *s[:, 1].tolist()], [*s[:, 0].tolist(), len(b)])) for s, b in zip(spans, bodies)]
            listed = [[{"start": int(x), "stop": int(y)} for x, y in s] for s in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid"), pa.array(listed, kind), pa.array(kept, pa.binary())], names=["tid", "spans", "kept"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> tuple[DataFrame, int]:
    """Texts that hold repeats: ``tid`` (MD5 of the bytes), ``spans`` (start, stop) to remove, ``kept`` bytes; and their number."""
    shape = Shape(length)
    marks, texts = _marks(docs, shape, crowd)
    found = _texts_of(docs, marks, texts).join(marks, "tid")
    return found.mapInArrow(_cut(shape), "tid binary, spans array<struct<start:long,stop:long>>, kept binary"), texts


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All documents with their columns, and ``kept_bytes``: the text's bytes but for all repeated windows."""
    found, texts = repeated_spans(docs, length)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    one = docs.select(held, F.unhex(F.md5(body)).alias("tid"), body.alias("_body"))
    return one.join(found.select("tid", "kept"), "tid", "left").select("_doc.*", F.coalesce("kept", "_body").alias("kept_bytes"))


def removals(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    found, texts = repeated_spans(docs, length, crowd)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    digests = durable(found.select(
        "tid", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_body"))
    one = one.select("doc_id", F.unhex(F.md5("_body")).alias("tid"), F.octet_length("_body").cast("long").alias("n_bytes"), F.sha2("_body", 256).alias("_sha"))
    return one.join(small_side(digests, texts), "tid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
    )
