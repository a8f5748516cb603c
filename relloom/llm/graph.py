"""Connected components and the reading of tables, shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.session import materialise, scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Edges that a task contracts at once.
CHUNK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes not to be a column of ``df``."""
    while name in df.columns:
        name += "_"
    return name


def keyed(docs: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """Written rows with a unique key of their own, and the key's name: ids may repeat or be null."""
    name = fresh(docs, name)
    return materialise(docs.withColumn(name, F.monotonically_increasing_id())), name


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Rounds until every node but the roots has one edge, to a root. Edges (u, v), v < u, are written to the shared
    folder after each round. First each task contracts the edges it reads, ``CHUNK`` at a time; what it
    writes is smaller, so fewer tasks read it, and as long as their number falls they contract again. Then a large-star step
    replaces an edge's smaller end by the smallest node that is joined to it, and a small-star step joins all
    smaller ends of a node to the smallest of them; the number of these rounds grows with the
    logarithm of the longest path. No edges give no rows.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    tasks = None
    while True:
        before, tasks = tasks, now.rdd.getNumPartitions()
        now = materialise(_contracted(now))
        if _stars(now):
            break
        if before is None or tasks < before:
            continue
        tasks = None
        least = now.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = now.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        now = materialise(small.select("e.*").where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that join the same nodes, each node to the smallest one that a task's chunk joins it with."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield _joined(held)
                held, rows = [], 0
        if rows:
            yield _joined(held)

    return edges.mapInArrow(run, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    u, v = (table[c].to_numpy() for c in ("u", "v"))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))  # nodes are in order, so the smallest number is the smallest node
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    kind = table.schema.field("u").type
    return pa.record_batch([pa.array(nodes[moved], kind), pa.array(nodes[root[moved]], kind)], names=["u", "v"])


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller ends, or one and a larger one."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")),
    )).alias("e")).select("e.*")
    sums = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sums.where("below > 1 OR below = 1 AND above = 1").limit(1).count() == 0


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Written (node, root) of ``components`` after more links (a, b): only their ends' roots are joined."""
    if links.isEmpty():
        return roots
    ends = {}
    for end in "ab":
        found = roots.select(F.col("node").alias(f"_n{end}"), F.col("root").alias(f"_r{end}"))
        links = links.join(found, F.col(end) == F.col(f"_n{end}"), "left")
        ends[end] = F.coalesce(f"_r{end}", end)
    new = materialise(components(links.select(*[c.alias(x) for x, c in ends.items()])))
    moved = new.select(F.col("node").alias("_root"), F.col("root").alias("_new"))
    kept = roots.join(moved, F.col("root") == F.col("_root"), "left").select("node", F.coalesce("_new", "root").alias("root"))
    return materialise(kept.unionByName(new).distinct())


class Steps:
    """Tables written between the steps of one job, which leave as soon as they are not needed.

    The shuffle files of a step go once its rows are written, and so do the tables named in ``done``:
    what a later step reads is in the shared folder, so a lost executor costs no more than its tasks.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame, done: tuple[str, ...] = ()) -> DataFrame:
        path = self.paths[name] = scratch_path(self.spark, name)
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.drop(*done)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for old in names:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(old))
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
