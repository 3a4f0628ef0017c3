"""Exact duplicates: group by a 128-bit content hash, compare the bytes inside groups, keep the smallest id.

Texts are equal when they are identical after every run of white space is replaced by one blank; a null text counts as
empty. Null ids come after all others. Rows that repeat both id and text are told apart only by which of them is kept:
one. Very long texts are hashed and compared whole. An empty table gives an empty result, other columns are carried through untouched or not read at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from storygauge.llm.common import SPACES, durable, small_side, staged, texts


def normalised(text: Column) -> Column:
    blanks = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.regexp_replace(blanks, " {2,}", " ")


def md5_digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


class Groups:
    """Staged rows ``doc_id, _key, _sha, _row`` and the groups of more than one row ``_key, _first, _n``.

    ``digest`` gives the hash that groups are made by. The bytes of every group are compared; should two different texts
    ever share a hash, the texts themselves become the key. Only the groups' smallest and largest text per task travel
    for that comparison, so a group that holds a third of all rows costs two texts a task.
    """

    def __init__(self, docs: DataFrame, digest: Callable[[Column], Column] = md5_digest):
        source = texts(docs).select("doc_id", normalised(F.col("text")).alias("_text"))
        for key in (digest, lambda t: t.cast("binary")):
            self.key = key
            keyed = source.withColumn("_key", key(F.col("_text")))
            self.rows = durable(keyed.select(
                "doc_id", "_key", F.unhex(F.sha2("_text", 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row"),
            ))
            first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
            groups = self.rows.groupBy("_key").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
            self.repeated, self.count = staged(groups.filter("_n > 1"))
            shared = keyed.join(small_side(self.repeated.select("_key"), self.count), "_key", "left_semi")
            bounds = shared.groupBy("_key").agg(F.min("_text").alias("_least"), F.max("_text").alias("_most"))
            if bounds.filter("_least <> _most").isEmpty():
                break

    def matched(self, rows: DataFrame) -> DataFrame:
        """The rows with ``_first`` and ``_n`` of their group, null where nothing equals them."""
        return rows.join(small_side(self.repeated, self.count), "_key", "left")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = md5_digest) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256`` (of the normalised text)."""
    groups = Groups(docs, digest)
    alone = F.col("_n").isNull()
    return groups.matched(groups.rows).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_first._row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = md5_digest) -> DataFrame:
    """The documents that stay, with all their columns.

    The texts are never shuffled while the groups' table is small enough to be sent; else they are joined by hash. Rows
    that repeat an id and a text exactly need a second look, which only those rows take.
    """
    groups = Groups(docs, digest)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    one = docs.select(held, groups.key(normalised(F.col("text"))).alias("_key"), F.col("doc_id").cast("long").alias("_id"))
    kept = groups.matched(one).filter(F.col("_n").isNull() | F.col("_id").eqNullSafe(F.col("_first.doc_id")))
    firsts = groups.matched(groups.rows).filter(F.col("doc_id").eqNullSafe(F.col("_first.doc_id")))
    twice, count = staged(firsts.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_key"))
    if count:
        again = kept.join(small_side(twice, count), "_key", "left_semi")
        place = Window.partitionBy("_key").orderBy(F.to_json("_doc"))
        again = again.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")
        kept = kept.join(small_side(twice, count), "_key", "left_anti").unionByName(again)
    return kept.select("_doc.*")
