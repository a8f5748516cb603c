"""Exact duplicates and label conflicts.

Copies of one row may be a large part of the corpus. Every operator here either combines on
the map side before it shuffles by key, or joins on the unique ``id``; no task ever holds all
copies of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relloom.session import lookup

EXACT = ["sentence", "subject_entity", "object_entity", "source", "label"]
NO_LABEL = ["sentence", "subject_entity", "object_entity"]


def _per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def _singles(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of the rows that share their key with no other row."""
    return _per_key(df, keys).where("n = 1").select(F.col("first_id").alias("id"))


def dedup(df: DataFrame, keys: list[str] = EXACT, keep: str = "first") -> DataFrame:
    """One row per key, with the smallest (or largest) id.

    The rank filter is a literal 1, so Spark limits each group on the map side before the shuffle.
    """
    order = F.col("id").asc() if keep == "first" else F.col("id").desc()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicates(df: DataFrame, keys: list[str] = EXACT, keep: str | None = None) -> DataFrame:
    """Rows that repeat a key: all of them, or all but the first or last one."""
    if keep is None:
        spared = _singles(df, keys)
    else:
        spared = _per_key(df, keys).select(F.col(f"{keep}_id").alias("id"))
    return df.join(spared, "id", "left_anti")


def duplicates_diff(df: DataFrame, coarse: list[str], fine: list[str]) -> DataFrame:
    """Rows that repeat the coarse key but not the fine one."""
    only = _singles(df, fine).join(_singles(df, coarse), "id", "left_anti")
    return df.join(only, "id", "left_semi")


def relabelled(df: DataFrame) -> DataFrame:
    """Rows repeating (sentence, subject, object, source), for sentences seen with two labels."""
    keys = [*NO_LABEL, "source"]
    first = _per_key(df, [*keys, "label"]).select("sentence", "first_id")
    later = first.join(_per_key(df, keys).select("first_id"), "first_id", "left_anti")
    sentences = later.select("sentence").distinct()
    return duplicates(df, keys).join(sentences, "sentence", "left_semi").select(df.columns)


def _digest(columns: list[str]) -> Column:
    """32 bytes that stand for the texts of some columns; a null is a value of its own."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _conflict_ids(df: DataFrame) -> DataFrame:
    # Digests are shuffled, not sentences.
    # A key has at most one row per label after the first aggregation, so the window stays small.
    per_label = _per_key(df.select("id", "label", _digest(NO_LABEL).alias("_key")), ["_key", "label"])
    copies = F.sum("n").over(W.partitionBy("_key"))
    return (
        per_label.withColumn("copies", copies)
        .where("n = 1 AND copies > 1")
        .select(F.col("first_id").alias("id"), "_key", "label")
    )


def label_conflicts(df: DataFrame) -> DataFrame:
    """Rows whose key occurs more than once, but not with their own label."""
    return df.join(_conflict_ids(df).select("id"), "id", "left_semi")


def _conflict_losers(df: DataFrame) -> DataFrame:
    """Ids that lose: per conflicting key the label that is rarest in the corpus wins."""
    counts = lookup(df.groupBy("label").agg(F.count(F.lit(1)).alias("label_rows")))
    rank = F.row_number().over(W.partitionBy("_key").orderBy("label_rows", "label", "id"))
    ranks = _conflict_ids(df).join(counts, "label").withColumn("_rank", rank)
    return ranks.where("_rank > 1").select("id")


def resolve_conflicts(df: DataFrame) -> DataFrame:
    """Keep the rarest label of each conflicting key; all other rows stay."""
    return df.join(_conflict_losers(df), "id", "left_anti")


def drop_listed(df: DataFrame, ids: list[int] | DataFrame | None = None) -> DataFrame:
    """Remove rows by id; without a list, the rows that lose a label conflict."""
    if ids is None:
        return resolve_conflicts(df)
    if isinstance(ids, DataFrame):
        return df.join(ids.select("id"), "id", "left_anti")
    return df.where(~F.col("id").isin(*ids)) if ids else df


def dedup_report(df: DataFrame, keys: list[str] = EXACT) -> DataFrame:
    """Rows before and after dedup, and how many go."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
        .withColumn("removed", F.col("rows_before") - F.col("rows_after"))
    )
