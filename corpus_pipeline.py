"""A corpus cleaned, mixed and packed: stages that each apply one operator to all that the stage before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from storygauge.llm import exact_dedup, lang_id, mixing, near_dedup, packing
from storygauge.llm.common import documents, name_folder
from storygauge.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told; only those without letters go.

    Null and empty texts go with them; repeated rows, null ids and very long texts stay. An empty table stays empty.
    """
    return lang_id.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents whose texts are equal up to white space: the one with the smallest id, null ids last, one of repeated rows.

    Null texts are empty ones. Long texts are compared whole. An empty table stays empty.
    """
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near duplicates: the one with the smallest id, null ids last, one of repeated rows.

    Null texts are empty ones. Long texts are compared whole. An empty table stays empty.
    """
    return near_dedup.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the sources' weights take them; a repeated document is a repeated row.

    A null source is a source. Texts without words are never taken. An empty table gives an empty mix.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their training sequences.

    A null text has its end id only. Long texts are cut in pieces. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None  # hashes, sampling and token ids are beyond SQL; tests/llm compares the stages with brute force


def remove(spark: SparkSession, path: str) -> None:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next; only the last one's rows stay there."""
    docs = documents(spark, sf_dir)
    name_folder(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
        if place:
            remove(spark, f"{folder}/{place - 1}")
    return docs
