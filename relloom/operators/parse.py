"""Entity columns: dictionary literal in text -> word, offsets and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.rules import LABELS, literal_map

ENTITY = "word string, start_idx int, end_idx int, type string"
# Single quotes and \' are part of the literals; a broken literal must stop the job.
OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "FAILFAST"}


def entity(column: str) -> Column:
    return F.from_json(F.col(column), ENTITY, OPTIONS)


def parse_entities(df: DataFrame, partial: bool = False) -> DataFrame:
    """Overwrite both entity columns by the word and add offsets and type.

    ``partial`` leaves the literals in place and adds only word and type columns.
    """
    parsed = df.withColumns({"_subject": entity("subject_entity"), "_object": entity("object_entity")})
    if partial:
        added = [
            F.col(f"_{role}.{field}").alias(f"{role}_{field}")
            for role in ("subject", "object")
            for field in ("type", "word")
        ]
        return parsed.select(*df.columns, *added)
    words = {f"{role}_entity": F.col(f"_{role}.word") for role in ("subject", "object")}
    added = [
        F.col(f"_{role}.{field}").alias(f"{role}_{field}")
        for role in ("subject", "object")
        for field in ("start_idx", "end_idx", "type")
    ]
    return parsed.select(*[words.get(c, F.col(c)).alias(c) for c in df.columns], *added)


def _known(value: Column, key: Column, what: str) -> Column:
    """Mapped value; a key outside the dictionary is an error, NULL stays NULL."""
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), key.cast("string")))
    return F.when(value.isNull() & key.isNotNull(), unknown).otherwise(value)


def encode_labels(df: DataFrame, source: str = "label", target: str = "label_num") -> DataFrame:
    numbers = literal_map({name: i for i, name in enumerate(LABELS)})
    return df.withColumn(target, _known(numbers[F.col(source)], F.col(source), "label"))


def decode_labels(df: DataFrame, source: str = "label_num", target: str = "label") -> DataFrame:
    names = literal_map(dict(enumerate(LABELS)))
    return df.withColumn(target, _known(names[F.col(source)], F.col(source), "label number"))
