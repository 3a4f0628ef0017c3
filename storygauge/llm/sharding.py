"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on a ring, the hash of its id and text. Each shard owns ``virtual`` points of the ring; a row goes
to the first point at or after its place whose shard still has room, so rows beyond a full shard's load continue
clockwise. Rows enter in ring order. With ``slack`` 0 the loads add up to the number of rows exactly, so that counts are
at most one apart; with more slack fewer rows move when a shard is added.

Null texts have no bytes; null ids are ids of their own. Rows that repeat id and text share a place and are told apart
only by their slot. A very long text is one row like any other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window, functions as F

from storygauge.llm.common import durable, texts

CELL_BITS = 16  # the ring is counted in 65,536 cells; nothing larger than this table ever reaches the driver
VIRTUAL = 128


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order; a cell that several nodes hash to belongs to the first."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for i in range(virtual):
            cell = int.from_bytes(hashlib.sha256(f"{shard}/{i}".encode()).digest()[:8], "big") >> (64 - CELL_BITS)
            nodes.setdefault(cell, shard)
    return sorted(nodes.items())


def walk(counts: dict[int, int], shards: int, slack: float = 0.0, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, from, to, shard, slot of the first row) of the rows of each cell, by their rank in the cell.

    A row's search starts at the first node at or after its cell and goes on clockwise past shards that are full.
    """
    total = sum(counts.values())
    load = [total // shards + (s < total % shards) for s in range(shards)]
    if slack:
        load = [int(-(-total * (1 + slack) // shards))] * shards
    nodes = ring(shards, virtual)
    cells, used, segments = [c for c, _ in nodes], [0] * shards, []
    for cell in sorted(counts):
        node, done = bisect.bisect_left(cells, cell), 0
        while done < counts[cell]:
            while used[shard := nodes[node % len(nodes)][1]] >= load[shard]:
                node += 1
            take = min(counts[cell] - done, load[shard] - used[shard])
            segments.append((cell, done, done + take, shard, used[shard]))
            used[shard] += take
            done += take
    return segments


def place_rows(docs: DataFrame, shards: int, slack: float = 0.0, virtual: int = VIRTUAL) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``; slots of a shard run from 0 without gaps.

    Texts are read once; what is shuffled is one narrow row a document. Ranks are taken cell by cell.
    """
    spark = docs.sparkSession
    source = texts(docs)
    narrow = durable(source.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.xxhash64("doc_id", F.md5("text")).alias("_place"),
    ))
    cell = F.shiftrightunsigned("_place", 64 - CELL_BITS).cast("int")
    held = narrow.withColumn("_cell", cell)
    counts = {r[0]: r[1] for r in held.groupBy("_cell").count().collect()}  # at most 65,536 rows
    segments = spark.createDataFrame(walk(counts, shards, slack, virtual), "_cell int, _from long, _to long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_place", "doc_id", "text_crc32", "size")) - 1
    ranked = held.withColumn("_rank", rank)
    segment = F.broadcast(segments.groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "shard", "_slot"))).alias("_parts")))
    part = F.filter("_parts", lambda p: (p["_from"] <= F.col("_rank")) & (F.col("_rank") < p["_to"]))[0]
    return ranked.join(segment, "_cell").withColumn("_part", part).select(
        "doc_id", "size", "text_crc32", F.col("_part.shard").alias("shard"),
        (F.col("_part._slot") + F.col("_rank") - F.col("_part._from")).alias("slot"),
    )
