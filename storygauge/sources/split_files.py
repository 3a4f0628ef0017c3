"""Large CSV files and JSON arrays read in many tasks, though their records hold line breaks.

Spark cuts a text file where a separator stands, wherever it is, so each task reads a stretch of bytes as pieces of text. Whether
a piece lies inside a quoted text depends on all before it. So the file is read twice. First every stretch is summed up: whether
it holds an odd number of quotes, and by how much it changes the depth of brackets, for either way it may begin. Sums of the
stretches before, a few numbers each, then tell how each one begins. The second time every task cuts its own stretch into records;
what a stretch has of a record that begins or ends elsewhere is put together by a small shuffle.

No file is opened but by Spark's reader. What is outside the records of well-formed files is an error, not a guess.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from storygauge.session import durable

_STRETCH = ["file", "start"]
_SIGNS = re.compile(r'\\.|["{}\[\]]', re.S)
_BETWEEN = re.compile(r"[\s,\[\]\ufeff]*")


@dataclass(frozen=True)
class Lines:
    """CSV records: lines, joined while a quoted field is open. ``names`` is the header that every file must have."""

    names: tuple[str, ...]
    separator: str = "\n"

    def sum_up(self, piece: str) -> tuple[int, int, int]:
        """Whether it turns quoted text on or off, and the change of depth if it begins outside, or inside, quoted text."""
        return piece.count('"') & 1, 0, 0

    def ends(self, quoted: int, depth: int) -> bool:
        return not quoted

    def begins(self, piece: str) -> bool:
        return True

    def record(self, text: str) -> str | None:
        """The record without its line end; None for an empty line."""
        return text[:-1].removesuffix("\r") or None

    def head(self, text: str) -> bool:
        """Whether the first record of a file is its header; another one is an error."""
        found = next(csv.reader([text.removeprefix("\ufeff")]), [])
        if tuple(found) != self.names:
            raise ValueError(f"CSV header does not conform to the schema: {found}, expected {list(self.names)}")
        return True


@dataclass(frozen=True)
class Elements:
    """Objects of a JSON array, which closing braces cut into pieces."""

    separator: str = "}"

    def sum_up(self, piece: str) -> tuple[int, int, int]:
        quoted, deeper = 0, [0, 0]
        for sign in _SIGNS.findall(piece + self.separator):
            if sign == '"':
                quoted ^= 1
            elif len(sign) == 1:  # counts outside quoted text, whichever way the piece begins
                deeper[quoted] += 1 if sign in "{[" else -1
        return quoted, deeper[0], deeper[1]

    def ends(self, quoted: int, depth: int) -> bool:
        if depth < 1 and not quoted:
            raise ValueError("expected a JSON array of objects")
        return not quoted and depth == 1

    def begins(self, piece: str) -> bool:
        """False for what follows the last object of a stretch or an array, where no record begins."""
        rest = _BETWEEN.sub("", piece, count=1)
        if rest and not rest.startswith("{"):
            raise ValueError(f"expected a JSON array of objects, found {rest[:40]!r}")
        return bool(rest)

    def record(self, text: str) -> str | None:
        return text[text.index("{"):]

    def head(self, text: str) -> bool:
        return False


Shape = Lines | Elements


def _pieces(spark: SparkSession, path: str, shape: Shape) -> DataFrame:
    """The pieces of all files in the order of their stretches: ``file, start, value``."""
    text = spark.read.option("lineSep", shape.separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, list[str]]]:
    """Runs of pieces of one stretch (file and start), each with the place of its first row."""
    files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
    begin = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or (files[i], starts[i]) != (files[begin], starts[begin]):
            yield (files[begin], starts[begin]), begin, values[begin:i]
            begin = i


def _summed(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for stretch, _, values in _stretches(batch):
                state = held.setdefault(stretch, [0, 0, 0])  # parity, depth if it begins outside, or inside, quoted text
                for value in values:
                    parity, outside, inside = shape.sum_up(value)
                    turned = state[0]
                    state[1] += inside if turned else outside
                    state[2] += outside if turned else inside
                    state[0] ^= parity
        rows = [(f, s, *state) for (f, s), state in held.items()]
        if rows:
            names = ["file", "start", "parity", "outside", "inside"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return run


def _begun(pieces: DataFrame, shape: Shape) -> DataFrame:
    """How each stretch begins: ``file, start, quoted, depth``; one row a stretch."""
    sums = pieces.mapInArrow(_summed(shape), "file string, start long, parity long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = sums.withColumn("quoted", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    change = F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside"))
    if isinstance(shape, Elements):  # the last piece of a file has no brace after it, but is summed up as if it had
        open_ = quoted.groupBy("file").agg(F.sum(change).alias("depth")).filter("depth <> -1").select("file").head()
        if open_ is not None:
            raise ValueError(f"expected a JSON array in {open_.file}, but its brackets do not match")
    return durable(quoted.select("file", "start", "quoted", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth")))


class _Cutter:
    """Cuts the pieces of one stretch into records, from how the stretch begins."""

    def __init__(self, shape: Shape, quoted: int, depth: int, first: bool):
        self.shape, self.quoted, self.depth = shape, quoted, depth
        self.held: list[str] = []
        self.whole = not quoted and (depth == 0 or shape.ends(0, depth))  # what is held begins in this stretch
        self.first = first  # the next record is the first of its file

    def add(self, piece: str) -> tuple[str, str] | None:
        """The record that the piece ends, if it ends one, as its part and text."""
        parity, outside, inside = self.shape.sum_up(piece)
        self.depth += inside if self.quoted else outside
        self.quoted ^= parity
        if self.whole and not self.held and not self.shape.begins(piece):
            return None
        self.held.append(piece + self.shape.separator)
        if not self.shape.ends(self.quoted, self.depth):
            return None
        text, whole = "".join(self.held), self.whole
        self.held, self.whole = [], True
        if not whole:
            return "head", text
        record = self.shape.record(text)
        if record is None or (self.first and self.shape.head(record)):
            self.first = self.first and record is None
            return None
        self.first = False
        return "all", record

    def rest(self) -> tuple[str, str] | None:
        if not self.held:
            return None
        if self.first and self.whole and isinstance(self.shape, Lines):
            raise ValueError("CSV header does not conform to the schema: it does not end")
        return "tail" if self.whole else "middle", "".join(self.held)


def _cut(shape: Shape):
    """Records ``file, start, part, text``: whole ones have part ``all``, others ``head``, ``middle`` or ``tail`` of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters: dict[tuple[str, int], _Cutter] = {}

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "start", "part", "text"])

        for batch in batches:
            rows = []
            for stretch, at, values in _stretches(batch):
                if stretch not in cutters:
                    quoted, depth = (batch.column(c)[at].as_py() for c in ("quoted", "depth"))
                    cutters[stretch] = _Cutter(shape, quoted, depth, stretch[1] == 0)
                rows += [(*stretch, *found) for found in map(cutters[stretch].add, values) if found]
            if rows:
                yield sent(rows)
        rows = [(*stretch, *rest) for stretch, cutter in cutters.items() if (rest := cutter.rest())]
        if rows:
            yield sent(rows)

    return run


def _joined(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shape.record("".join(parts)) for parts in batch.column("texts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    return run


def records(spark: SparkSession, path: str, shape: Shape) -> DataFrame:
    """The ``text`` of every record of all files at ``path``."""
    pieces = _pieces(spark, path, shape)
    begun = _begun(pieces, shape)
    cut = durable(pieces.join(F.broadcast(begun), _STRETCH).mapInArrow(_cut(shape), "file string, start long, part string, text string"))
    place = F.when(F.col("part") == "head", 0).when(F.col("part") == "middle", 1).otherwise(2)
    order = Window.partitionBy("file").orderBy("start", "place")
    loose = cut.filter("part <> 'all'").withColumn("place", place)  # at most two a stretch
    chain = loose.withColumn("chain", F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(order))
    ordered = F.sort_array(F.collect_list(F.struct("start", "place", "text", "part")))
    chains = chain.groupBy("file", "chain").agg(ordered.alias("parts"))
    ended = F.element_at("parts", -1)["part"] == "head"
    texts = F.when(ended, F.transform("parts", lambda p: p["text"])).otherwise(
        F.raise_error(F.concat(F.lit("a record does not end in "), F.col("file"))).cast("array<string>"))
    whole = cut.filter("part = 'all'").select("text")
    return whole.unionByName(chains.select(texts.alias("texts")).mapInArrow(_joined(shape), "text string"))


def outgrows_a_task(spark: SparkSession, path: str) -> bool:
    """Whether a file at ``path`` is larger than what Spark gives one task to read."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = held.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(held):
        return False
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return any(s.isFile() and s.getLen() > most for s in system.listStatus(held))
