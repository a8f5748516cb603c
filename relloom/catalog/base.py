"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relloom.corpus import RUN, RUNS_PER_DOC
from relloom.rules import LABELS, NUM_LABELS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is run by DuckDB on the same tables."""

    def keep(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _quoted(names: list[str]) -> str:
    return ", ".join("'" + n + "'" for n in names)


LABEL_LIST = f"[{_quoted(LABELS)}]"


def rel_cte(source: str = "SELECT doc_id, source, text FROM documents", name: str = "rel") -> str:
    """The relation corpus in SQL, as a chain of CTEs ending in ``name``."""
    return f"""
{name}_tok AS (
  SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '') AS all_w
  FROM ({source})
), {name}_cut AS (
  SELECT doc_id, source, all_w, greatest(1, len(all_w) // {RUN}) AS k FROM {name}_tok WHERE len(all_w) > 0
), {name}_pos AS (
  SELECT doc_id, source, all_w, k, unnest(range(0, k)) AS chunk FROM {name}_cut
), {name}_part AS (
  SELECT doc_id, source, chunk,
    CASE WHEN chunk = k - 1 THEN all_w[chunk * {RUN} + 1:] ELSE all_w[chunk * {RUN} + 1:(chunk + 1) * {RUN}] END AS w
  FROM {name}_pos
), {name}_run AS (
  SELECT doc_id, source, chunk,
    CASE WHEN len(w) >= 6 THEN w ELSE list_transform(range(0, 6), lambda i: w[i % len(w) + 1]) END AS w
  FROM {name}_part
), {name}_pick AS (
  SELECT *, CAST(length(w[1]) % 3 AS INT) AS a, CAST(3 + length(w[2]) % 2 AS INT) AS b, length(w[3]) % 2 AS o
  FROM {name}_run
), {name}_span AS (
  SELECT doc_id, chunk, source, o, array_to_string(w, ' ') AS sentence, w[a + 1] AS wa, w[b + 1] AS wb,
    CASE WHEN a = 0 THEN 0 ELSE length(array_to_string(w[1:a], ' ')) + 1 END AS sa,
    length(array_to_string(w[1:b], ' ')) + 1 AS sb
  FROM {name}_pick
), {name}_ent AS (
  SELECT doc_id * {RUNS_PER_DOC} + chunk AS id, doc_id, chunk, sentence, source,
    CASE WHEN o = 0 THEN wa ELSE wb END AS subject_entity,
    CASE WHEN o = 0 THEN wb ELSE wa END AS object_entity,
    CAST(CASE WHEN o = 0 THEN sa ELSE sb END AS INT) AS subject_start_idx,
    CAST(CASE WHEN o = 0 THEN sb ELSE sa END AS INT) AS object_start_idx
  FROM {name}_span
), {name}_num AS (
  SELECT id, sentence, source, subject_entity, subject_start_idx,
    CAST(subject_start_idx + length(subject_entity) - 1 AS INT) AS subject_end_idx,
    CASE WHEN length(subject_entity) % 2 = 0 THEN 'PER' ELSE 'ORG' END AS subject_type,
    object_entity, object_start_idx,
    CAST(object_start_idx + length(object_entity) - 1 AS INT) AS object_end_idx,
    ['PER', 'ORG', 'LOC', 'DAT', 'POH', 'NOH'][length(object_entity) % 6 + 1] AS object_type,
    CAST(CASE WHEN length(sentence) % 4 = 0 THEN 0
              WHEN (doc_id + chunk) % 5 = 0 THEN (doc_id * 7 + chunk) % {NUM_LABELS}
              ELSE (length(sentence) * 7) % {NUM_LABELS} END AS INT) AS label_num
  FROM {name}_ent
), {name} AS (
  SELECT *, {LABEL_LIST}[label_num + 1] AS label FROM {name}_num
)"""


REL = rel_cte()
TEST = rel_cte("SELECT item_id AS doc_id, 'benchmark' AS source, text FROM benchmark", "test_rel")


def scored_cte(run: int, name: str = "scored", rows: str = "rel") -> str:
    """Probabilities of one run as (id, label_num, probs DOUBLE[30])."""
    return f"""
{name}_w AS (
  SELECT id, label_num, subject_type, object_type,
    list_transform(range(0, {NUM_LABELS}), lambda c:
      CAST(1 + (id * 31 + c * 17 + {run * 7}) % 97
        + CASE WHEN c = label_num AND (id + {run}) % 3 <> 0 THEN 97 ELSE 0 END AS DOUBLE)) AS w
  FROM {rows}
), {name} AS (
  SELECT id, label_num, subject_type, object_type,
    list_transform(w, lambda x: x / list_sum(w)) AS probs
  FROM {name}_w
)"""


def with_rel(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([REL, *ctes]) + "\n" + body
