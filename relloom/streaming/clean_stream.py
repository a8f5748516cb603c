"""Row-wise cleaning steps over rows that keep arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from relloom.operators.clean import NOT_ROWWISE, clean
from relloom.sources.relations import SCHEMAS


def stream_relations(
    spark: SparkSession, path: str, kind: str = "parsed", max_files: int | None = None
) -> DataFrame:
    """Relation rows from parquet files as they are put into a folder, ``max_files`` of them in a batch."""
    reader = spark.readStream.schema(SCHEMAS[kind])
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def clean_stream(df: DataFrame, steps: Sequence[str | tuple[str, dict]]) -> DataFrame:
    """The cleaning chain on a stream; steps that group rows or join tables are refused."""

    def rowwise(step: str | tuple[str, dict]) -> bool:
        name, args = (step, {}) if isinstance(step, str) else step
        return name not in NOT_ROWWISE and not any(isinstance(v, DataFrame) for v in args.values())

    grouped = [s if isinstance(s, str) else s[0] for s in steps if not rowwise(s)]
    if grouped:
        raise ValueError(f"steps need the whole table: {grouped}")
    return clean(df, steps)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop; the next start goes on from the checkpoint."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
