"""Expressions over probability and logit arrays; everything stays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: inside a lambda Spark would compute it again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    return let(
        F.array_max(logits),
        lambda top: let(
            F.transform(logits, lambda x: F.exp(x - top)),
            lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)),
        ),
    )


def log_sum_exp(logits: Column) -> Column:
    return let(
        F.array_max(logits),
        lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))),
    )


def argmax(values: Column) -> Column:
    """0-based index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def explode_once(df: DataFrame, keep: list[str], values: Column, pos: str, value: str) -> DataFrame:
    """``keep`` columns with one row per element of a computed array.

    The plain explode makes Spark infer a filter on the array's size below it, and an array
    that is computed there is computed twice. The outer form has no such filter.
    """
    return df.select(*keep, F.posexplode_outer(values).alias(pos, value)).where(F.col(pos).isNotNull())
