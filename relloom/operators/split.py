"""Train/valid splits. All of them are functions of ``id`` and a seed, so retries agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relloom.functions.text import hash_order
from relloom.operators.ranking import ranked
from relloom.session import lookup

# Digits of the hash that one histogram tells apart: 16**DIGITS buckets per stratum at most.
DIGITS = 4
# The bucket that holds a cut is cut again until it has no more rows than this.
EDGE_ROWS = 50_000
HASH_DIGITS = 32


def _same_stratum(strata: list[str]) -> Column:
    on = F.lit(True)
    for c in strata:
        on &= F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return on


def _edges(buckets: DataFrame, strata: list[str], take: Column) -> DataFrame:
    """Per stratum the bucket where its cut falls, its rows, and how many of them are taken.

    ``take`` may use ``n``, the rows of the stratum in ``buckets``.
    """
    whole = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    upto = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    placed = buckets.withColumns({"_upto": F.sum("_rows").over(upto), "n": F.sum("_rows").over(whole)})
    return lookup(
        placed.withColumn("_left", take.cast("long") - (F.col("_upto") - F.col("_rows")))
        .where("_left > 0 AND _left <= _rows")
        .select(*[F.col(c).alias(f"_s_{c}") for c in strata], F.col("_bucket").alias("_edge"), F.col("_left").alias("_take"), "_rows")
    )


def edge_buckets(narrow: DataFrame, strata: list[str], size: Column) -> tuple[DataFrame, int]:
    """Radix selection: ``_edges`` of at most EDGE_ROWS rows each, and the digits that tell them apart.

    Each round counts the rows of the last round's edges by ``DIGITS`` more digits of ``_key``.
    Only rows of one and the same key, copies of an id, may be more: the digits end there.
    """
    first = narrow.withColumn("_bucket", F.substring("_key", 1, DIGITS))
    buckets = first.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    edges, digits = _edges(buckets, strata, size), DIGITS
    while digits < HASH_DIGITS and (edges.agg(F.max("_rows")).first()[0] or 0) > EDGE_ROWS:
        inside = narrow.join(edges, _same_stratum(strata) & (F.substring("_key", 1, digits) == F.col("_edge")))
        digits = min(digits + DIGITS, HASH_DIGITS)
        inside = inside.withColumn("_bucket", F.substring("_key", 1, digits))
        buckets = inside.groupBy(*strata, "_take", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        edges = _edges(buckets, strata, F.col("_take"))
    return edges, digits


def _hash_cut(df: DataFrame, strata: list[str], size: Column, seed: int) -> DataFrame:
    """Add ``split``: per stratum the ``size`` rows that come first in hash order are valid.

    ``size`` is an expression over ``n``, the rows of the stratum. The rows themselves are
    never shuffled: histograms of hash prefixes narrow the cut down to a bucket of bounded size,
    ranking that one bucket gives the exact cut, and the cuts (one row per stratum) are joined back.
    """
    keyed = df.withColumn("_key", hash_order(seed, F.col("id")))
    narrow = keyed.select(*strata, "_key")
    edges, digits = edge_buckets(narrow, strata, size)
    prefix = F.substring("_key", 1, digits)
    # Copies of a key lie on the same side of the cut, so they are one row here.
    in_edge = (
        narrow.join(edges, _same_stratum(strata) & (prefix == F.col("_edge")))
        .groupBy(*strata, "_take", "_key").agg(F.count(F.lit(1)).alias("_rows"))
    )
    whole = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    upto = F.sum("_rows").over(whole.orderBy("_key").rowsBetween(W.unboundedPreceding, 0))
    cuts = lookup(
        in_edge.withColumn("_upto", upto)
        .where("_upto >= _take AND _upto - _rows < _take")
        .select(*[F.col(c).alias(f"_s_{c}") for c in strata], F.col("_key").alias("_cut"))
    )
    valid = F.col("_key") <= F.col("_cut")
    if strata:
        placed = keyed.join(cuts, _same_stratum(strata), "left")
    else:
        placed = keyed.withColumn("_cut", cuts.select("_cut").scalar())
    split = F.when(valid, "valid").otherwise("train").alias("split")
    return placed.select(*df.columns, split)


def stratified_split(
    df: DataFrame, strata: str = "label", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Exactly round(n * test_size) valid rows per stratum, drawn by hash of the id."""
    return _hash_cut(df, [strata], F.round(F.col("n") * F.lit(test_size)), seed)


def random_split(
    df: DataFrame, test_size: float = 0.3, seed: int = 42, extra_train: DataFrame | None = None
) -> DataFrame:
    """ceil(n * test_size) valid rows; ``extra_train`` rows are added to the train part."""
    split = _hash_cut(df, [], F.ceil(F.col("n") * F.lit(test_size)), seed)
    if extra_train is None:
        return split
    return split.unionByName(extra_train.withColumn("split", F.lit("train")), allowMissingColumns=True)


def score_split(
    df: DataFrame, score: str = "prob_1", strata: str = "label", test_size: float = 0.2
) -> DataFrame:
    """Per label the floor(n * test_size) rows that look most like test rows become valid.

    Only (id, label, score) is ranked; the last valid row of each label is joined back, so the
    full rows do not shuffle.
    """
    narrow = df.select("id", F.col(strata).alias("_s"), F.col(score).alias("_cut"))
    places = ranked(narrow, ["_s"], [F.col("_cut").desc(), F.col("id").asc()])
    last = F.floor(F.col("rn_total") * F.lit(test_size))
    cuts = lookup(places.where(F.col("rn") == last).select("_s", "_cut", F.col("id").alias("_id")))
    placed = df.join(cuts, F.col(strata).eqNullSafe(F.col("_s")), "left")
    above = (F.col(score) > F.col("_cut")) | ((F.col(score) == F.col("_cut")) & (F.col("id") <= F.col("_id")))
    return placed.select(*df.columns, F.when(above, "valid").otherwise("train").alias("split"))


def no_split(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.lit("train"))


def origin_table(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows (0) and test rows (1) in one table, column ``comes_from``."""
    return train.withColumn("comes_from", F.lit(0)).unionByName(
        test.withColumn("comes_from", F.lit(1)), allowMissingColumns=True
    )


def export_split(df: DataFrame, path: str) -> None:
    """Write the parts of a split next to each other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def attach_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Add score columns by id; a row without its counterpart on either side is an error."""
    added = [c for c in scores.columns if c != "id"]
    both = df.withColumn("_left", F.lit(True)).join(
        scores.withColumn("_right", F.lit(True)), "id", "full_outer"
    )
    missing = F.col("_left").isNull() | F.col("_right").isNull()
    lost = F.raise_error(F.concat(F.lit("no counterpart for id "), F.col("id").cast("string")))
    return both.select(
        *[F.when(missing, lost).otherwise(F.col(c)).alias(c) if c == "id" else F.col(c) for c in df.columns],
        *added,
    )
