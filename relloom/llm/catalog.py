"""Named queries of the numbered operators, with the SQL they must equal where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relloom.llm import (
    conversation_repair,
    decontaminate,
    language_id,
    minhash_dedup,
    mixing,
    quality,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filters,
    vector_codes,
)
from relloom.llm.graph import table
from relloom.llm.oracles import CONTAMINATION_SQL, NEAR_DUPLICATES_SQL, QUALITY_SQL


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.blocked(url_filters.capture_days(pages), url_filters.reported_entries(pages))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("passages")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("dist")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents")).drop("targets")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(suffix_dedup.removal(table(spark, sf_dir, "documents"))).drop("removed")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_substring_dedup, op3_minhash_near_dedup, op4_mixing, op5_token_counts,
        op6_toxicity, op7_quality_rules, op8_secret_scans, op9_decontamination, op10_suffix_dedup,
        op11_conversation_repair, op12_language_id, op13_vector_codes,
    )
}

ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.BLOCKED_SQL,
    "op3_minhash_near_dedup": NEAR_DUPLICATES_SQL,
    "op4_mixing": mixing.MIX_SQL,
    "op7_quality_rules": QUALITY_SQL,
    "op9_decontamination": CONTAMINATION_SQL,
    "op11_conversation_repair": conversation_repair.REPAIR_SQL,
    "op13_vector_codes": vector_codes.CODES_SQL,
}
