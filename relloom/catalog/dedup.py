"""Duplicates and label conflicts."""

from __future__ import annotations

from relloom.catalog.base import query, with_rel
from relloom.catalog.cleaning import parsed
from relloom.operators import dedup as dd

EXACT = "sentence, subject_entity, object_entity, source, label"
THREE = "sentence, subject_entity, object_entity"
FOUR = THREE + ", label"
NINE = [
    "sentence", "subject_entity", "object_entity", "label", "subject_start_idx",
    "object_start_idx", "subject_end_idx", "object_end_idx", "source",
]

for _keep, _order in (("first", "id"), ("last", "id DESC")):

    @query(
        f"dedup_{_keep}",
        with_rel(
            f"""SELECT id, sentence, source, label FROM (SELECT *, row_number() OVER (
                  PARTITION BY {EXACT} ORDER BY {_order}) AS rn FROM rel) WHERE rn = 1"""
        ),
    )
    def _dedup(spark, sf, keep=_keep):
        return dd.dedup(parsed(spark, sf), keep=keep).select("id", "sentence", "source", "label")

    @query(
        f"duplicates_but_{_keep}",
        with_rel(
            f"""SELECT id, sentence, label FROM (SELECT *, row_number() OVER (
                  PARTITION BY {FOUR} ORDER BY {_order}) AS rn FROM rel) WHERE rn > 1"""
        ),
    )
    def _repeats(spark, sf, keep=_keep):
        return dd.duplicates(parsed(spark, sf), FOUR.split(", "), keep).select("id", "sentence", "label")


for _name, _keys in (
    ("nine_columns", NINE),
    ("four_columns", FOUR.split(", ")),
    ("three_columns", THREE.split(", ")),
    ("with_source", [*THREE.split(", "), "source"]),
    ("all_but_id", [*NINE, "subject_type", "object_type"]),
):

    @query(
        f"duplicates_{_name}",
        with_rel(
            f"""SELECT id, sentence, label FROM (SELECT *, count(*) OVER (
                  PARTITION BY {', '.join(_keys)}) AS n FROM rel) WHERE n > 1 ORDER BY sentence, id"""
        ),
    )
    def _duplicates(spark, sf, keys=tuple(_keys)):
        rows = dd.duplicates(parsed(spark, sf), list(keys)).select("id", "sentence", "label")
        return rows.orderBy("sentence", "id")


@query(
    "duplicates_diff",
    with_rel(
        f"""SELECT id, sentence, label FROM (
              SELECT *, count(*) OVER (PARTITION BY {FOUR}) AS coarse,
                count(*) OVER (PARTITION BY {', '.join([*NINE, 'subject_type', 'object_type'])}) AS fine FROM rel)
            WHERE coarse > 1 AND fine = 1"""
    ),
)
def diff(spark, sf):
    fine = [*NINE, "subject_type", "object_type"]
    return dd.duplicates_diff(parsed(spark, sf), FOUR.split(", "), fine).select("id", "sentence", "label")


@query(
    "relabelled",
    with_rel(
        f"""SELECT id, sentence, label FROM (
              SELECT *, count(*) OVER (PARTITION BY {THREE}, source) AS n FROM rel)
            WHERE n > 1 AND sentence IN (
              SELECT sentence FROM (SELECT sentence,
                row_number() OVER (PARTITION BY {THREE}, source, label ORDER BY id) AS r5,
                row_number() OVER (PARTITION BY {THREE}, source ORDER BY id) AS r4 FROM rel)
              WHERE r5 = 1 AND r4 > 1)"""
    ),
)
def relabelled(spark, sf):
    return dd.relabelled(parsed(spark, sf)).select("id", "sentence", "label")


CONFLICTS = f"""
conflicts AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {THREE}) AS n3,
    count(*) OVER (PARTITION BY {FOUR}) AS n4 FROM rel) WHERE n3 > 1 AND n4 = 1
), label_rows AS (SELECT label, count(*) AS label_rows FROM rel GROUP BY label),
losers AS (
  SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {THREE} ORDER BY label_rows, label, id) AS rn
    FROM conflicts JOIN label_rows USING (label)) WHERE rn > 1
)"""


@query("label_conflicts", with_rel("SELECT id, sentence, label FROM conflicts", CONFLICTS))
def conflicts(spark, sf):
    return dd.label_conflicts(parsed(spark, sf)).select("id", "sentence", "label")


@query(
    "resolve_conflicts",
    with_rel("SELECT id, sentence, label FROM rel WHERE id NOT IN (SELECT id FROM losers)", CONFLICTS),
)
def resolved(spark, sf):
    return dd.resolve_conflicts(parsed(spark, sf)).select("id", "sentence", "label")


@query(
    "drop_listed",
    with_rel(
        "SELECT id, label FROM rel WHERE id NOT IN (SELECT id FROM conflicts WHERE label = 'no_relation')",
        CONFLICTS,
    ),
)
def dropped(spark, sf):
    """The listed rows: those in a conflict that claim no relation."""
    rows = parsed(spark, sf)
    listed = dd.label_conflicts(rows).where("label = 'no_relation'").select("id")
    return dd.drop_listed(rows, listed).select("id", "label")


@query(
    "dedup_report",
    with_rel(
        f"""SELECT count(*) AS rows_before, count(DISTINCT ({EXACT})) AS rows_after,
              count(*) - count(DISTINCT ({EXACT})) AS removed FROM rel"""
    ),
)
def report(spark, sf):
    return dd.dedup_report(parsed(spark, sf))
