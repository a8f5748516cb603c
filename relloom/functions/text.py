"""String expressions shared by the cleaning and profiling operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(text: Column, first: Column, last: Column) -> Column:
    """Characters first..last, 0-based and both inclusive; empty if last < first."""
    return text.substr(first + 1, F.greatest(last - first + 1, F.lit(0)))


def after(text: Column, last: Column) -> Column:
    """Everything behind the 0-based position ``last``."""
    return text.substr(last + 2, F.length(text))


def words(text: Column) -> Column:
    """Blank-separated words without empty ones."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def hash_order(seed: int, *parts: Column) -> Column:
    """32 hex digits, the same in every engine and for every partitioning: md5('seed:a:b')."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def share_digits(share: float) -> str:
    """First 8 hex digits below which a ``share`` of all hash values lies."""
    return f"{int(share * 2**32):08x}"
