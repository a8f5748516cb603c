"""Augmentation: new rows from label-aware swaps of entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom import rules
from relloom.operators.ranking import ranked


def swap_relations(df: DataFrame, swap_spans: bool = False) -> DataFrame:
    """Rows whose label allows it, with subject and object words swapped and the label mapped.

    Offsets and types stay with their old role unless ``swap_spans``.
    """
    fields = ["entity", "start_idx", "end_idx", "type"] if swap_spans else ["entity"]
    swapped = {f"{a}_{f}": F.col(f"{b}_{f}") for f in fields for a, b in (("subject", "object"), ("object", "subject"))}
    swapped["label"] = rules.literal_map(rules.SWAP_MAP)[F.col("label")]
    return df.where(F.col("label").isin(*rules.SWAP_MAP)).select(
        *[swapped.get(c, F.col(c)).alias(c) for c in df.columns]
    )


def exchange_pairs(df: DataFrame) -> DataFrame:
    """Row i of n in a (label, object type, subject type) group takes the words of row n+1-i.

    Both words are replaced literally in the sentence, the subject first. A group may be a
    large part of the corpus: positions come from a range-partitioned rank over ids and words
    only, the join key (group, position) is unique, and so is the id that joins the rows.
    """
    group = ["label", "object_type", "subject_type"]
    eligible = df.where(
        (F.col("label") != rules.NO_RELATION) & F.col("object_type").isin(*rules.EXCHANGE_TYPES)
    )
    words = eligible.select(
        "id", *group, F.col("subject_entity").alias("_subject"), F.col("object_entity").alias("_object")
    )
    places = ranked(words, group, [F.col("id").asc()])
    mirrored = places.select(
        *group, (F.col("rn_total") + 1 - F.col("rn")).alias("rn"), "_subject", "_object"
    )
    partner = places.select("id", *group, "rn").join(mirrored, [*group, "rn"]).select(
        "id", "_subject", "_object"
    )
    new = {
        "sentence": F.replace(
            F.replace("sentence", F.col("subject_entity"), F.col("_subject")),
            F.col("object_entity"), F.col("_object"),
        ),
        "subject_entity": F.col("_subject"),
        "object_entity": F.col("_object"),
    }
    return eligible.join(partner, "id").select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


# Step names an augmentation list may hold.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "swap_sentence": swap_relations,
    "sub_obj_change_augment": exchange_pairs,
}


def register_step(name: str, step: Callable[..., DataFrame]) -> None:
    """Add an augmentation of one's own under a name usable in configs."""
    STEPS[name] = step


def augment(df: DataFrame, steps: Sequence[str] = ()) -> DataFrame:
    """Append the rows of every listed augmentation; each one sees the original rows only.

    Operators tell rows apart by ``id``: an added row gets one of its own, made from that of its
    origin and the step (for numbers below zero, so a negative id, as that of an added row, is an error), and
    ``origin_id`` names the row it comes from.
    """
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown augmentation {unknown}")
    numeric = df.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")

    def added(k: int, step: str) -> DataFrame:
        rows = STEPS[step](df).withColumn("origin_id", F.col("id"))
        own = -(F.col("id") * len(steps) + k + 1) if numeric else F.concat("id", F.lit(f"#{step}"))
        return rows.withColumn("id", own.cast("bigint") if numeric else own)

    if numeric and steps:
        used = F.raise_error(F.concat(F.lit("augmented already, or a negative id: "), F.col("id").cast("string")))
        df = df.withColumn("id", F.when(F.col("id") < 0, used).otherwise(F.col("id")))
    first = df.withColumn("origin_id", F.col("id"))
    if numeric:
        first = first.withColumn("id", F.col("id").cast("bigint"))
    return reduce(DataFrame.unionByName, [added(k, s) for k, s in enumerate(steps)], first) if steps else df
