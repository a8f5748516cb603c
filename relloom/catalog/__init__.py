"""All named queries, by topic."""

from relloom.catalog import cleaning, dedup, profiling, scoring, sources, splits, tokens  # noqa: F401
from relloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
