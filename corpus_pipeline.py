"""A training-data pipeline over ``documents``: five stages, each written before the next one reads it.

All stages but the last return the columns of ``documents``; the last adds the mix's columns. Null
texts, empty tables, repeated rows and extra columns are handled as the operators' docstrings state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.llm import decontaminate, minhash_dedup, mixing, quality, secret_scan
from relloom.llm.graph import fresh, table
from relloom.session import scratch_path

#: The robust outliers and the min-hash join are not expressible in one SQL statement of use.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Each row is judged by its own text, whatever its id."""
    return quality.good_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash_dedup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; ``n_chars`` follows the text."""
    return _counted(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; ``n_chars`` follows the text."""
    return _counted(secret_scan.without_secrets(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (``copies``) and how many words (``taken``).

    The mix's columns get an underscore behind their names where ``documents`` has such a column.
    """
    names = {"size": fresh(docs, "mix_size")} | {c: fresh(docs, c) for c in ("source_size", "target", "copies", "taken")}
    return mixing.taken_rows(docs, names)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
