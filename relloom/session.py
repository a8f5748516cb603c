"""Session set-up, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def local_session(cpus: int | str = "*", app: str = "relloom") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; on a cluster
    a missing setting is an error, since a machine-local folder dies with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is not None and folder.startswith("file:") and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must not be a machine-local folder on a cluster")
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="relloom-")
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for a table written between two steps."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a step's rows to the shared folder and go on from there.

    Later reads see one fixed set of rows, whatever executor is lost, and only the columns
    they need.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame) -> DataFrame:
    """Small side of a join, computed once and written.

    There is no hint: Spark knows the size of the written files, broadcasts them if they are
    below its threshold, and shuffles beyond it.
    """
    return materialise(df)
