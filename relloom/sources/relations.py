"""Reading and writing relation rows and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "id bigint, sentence string, subject_entity string, object_entity string, label string, source string"
PARSED = (
    RAW + ", subject_start_idx int, subject_end_idx int, subject_type string,"
    " object_start_idx int, object_end_idx int, object_type string"
)
SCORED = PARSED + ", prob_1 double"
# Column order of the files.
SCHEMAS = {"raw": RAW, "parsed": PARSED, "scored": SCORED}


def read_relations(spark: SparkSession, path: str, kind: str = "raw", multi_line: bool = True) -> DataFrame:
    """Relation rows from CSV with a header; a line that does not fit the schema stops the job.

    A multi-line file cannot be split between tasks: give many files, or write parquet once
    and read that from then on. ``multi_line=False`` splits files whose texts hold no breaks.
    """
    return (
        spark.read.schema(SCHEMAS[kind])
        .option("header", True)
        # Columns in another order are an error, not a mix-up.
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        # Only a missing value is NULL; a quoted empty text is a text.
        .option("nullValue", "\u0001")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_relations(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV for exchange, parquet for arrays and for anything read again."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a list with one entry per line; line ends and outer blanks go."""
    word = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()
