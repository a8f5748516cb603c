"""Running totals and ranks inside groups of any size.

A window partitioned by label sends a whole label to one task. Here rows are range
partitioned by (group, order key), so a large group spreads over many tasks; each task
needs only the sum of what lies before it, and that table has one row per group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relloom.session import lookup, materialise


def running_totals(
    df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]
) -> DataFrame:
    """Add ``name`` (total up to and including the row) and ``name_total`` (of the group).

    ``order`` must tell all rows of a group apart. The placed rows are written out: the part
    numbers are read twice and must not change when an executor is lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc() for c in group]
    placed = materialise(
        df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    per_part = placed.groupBy(*group, "_part").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = lookup(
        per_part.select(
            *[F.col(c).alias(f"_g_{c}") for c in group],
            F.col("_part").alias("_g_part"),
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in values],
            *[F.sum(n).over(whole).alias(f"{n}_total") for n in values],
        )
    )
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = placed.select("*", *[F.sum(v).over(inside).alias(f"_in_{n}") for n, v in values.items()])
    on = F.col("_part") == F.col("_g_part")
    for c in group:
        on &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(offsets, on).select(
        *df.columns,
        *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in values],
        *[F.col(f"{n}_total") for n in values],
    )


def ranked(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Add ``rn`` (1-based position in the group) and ``rn_total`` (rows of the group)."""
    return running_totals(df, group, order, {"rn": F.lit(1)})
