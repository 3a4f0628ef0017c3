"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from storygauge.llm import (
    divergence, exact_dedup, fingerprints, lang_id, licenses, mixing, near_dedup, packing, private_data, repeats, sharding, toxicity,
    vector_codes,
)
from storygauge.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op2_ring_shards(spark: SparkSession, directory: str) -> DataFrame:
    placed = sharding.place_rows(documents(spark, directory), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_exact_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, directory))


@query
def op5_pareto_mix(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, directory))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query
def op1_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    made = fingerprints.with_edited(documents(spark, directory))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fingerprints.as_hex(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query
def op6_private_data(spark: SparkSession, directory: str) -> DataFrame:
    found = private_data.find_private(documents(spark, directory))
    counts = [private_data.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in private_data.PATTERNS]
    return found.select(
        "doc_id", *counts, F.sha2(private_data.listed(F.col("base")), 256).alias("base_sha256"),
        private_data.listed(F.col("spans")).alias("spans"),
    )


@query
def op8_tiered_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(documents(spark, directory))


@query
def op9_language_id(spark: SparkSession, directory: str) -> DataFrame:
    return lang_id.identify(documents(spark, directory))


@query
def op10_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, directory))


@query
def op7_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, directory), spark.read.parquet(f"{directory}/labels.parquet"))


@query
def op4_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan(documents(spark, directory))


@query
def op11_source_divergence(spark: SparkSession, directory: str) -> DataFrame:
    return divergence.audit(documents(spark, directory))


@query
def op13_vector_codes(spark: SparkSession, directory: str) -> DataFrame:
    return vector_codes.with_label_errors(vector_codes.compress(spark.read.parquet(f"{directory}/embeddings.parquet")))


@query
def op12_repeated_passages(spark: SparkSession, directory: str) -> DataFrame:
    return repeats.removals(documents(spark, directory))
