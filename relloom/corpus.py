"""Relation corpora derived from the ``documents`` table, for queries, tests and the bench.

A document's words are cut into runs of ``RUN`` words; each run is one sentence, the last run
takes the remainder, so every word of every document is used. A text of fewer than six words is one run
that repeats them up to six; a text without words has no run. Two words of each run are the
entities. Types and label follow from word lengths, so copies of a document give duplicate
rows, and every fifth row takes its label from the id, which gives label conflicts.
"""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.functions.arrays import explode_once, let, total
from relloom.rules import LABELS, NUM_LABELS
from relloom.session import scratch_path

RUN = 24
RUNS_PER_DOC = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Place rows of an input that too few tasks would read; an evenly read one stays as it is.

    Splits of a file are not tasks with work: those in which no row group starts are empty. So rows are counted
    by split, which reads no more than the files' footers.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores:
        rows = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        seen = rows.agg(F.count(F.lit(1)).alias("filled"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
        if seen.filled >= cores and seen.most * seen.filled <= 2 * seen.n:
            return df
    return df.repartition(max(cores, splits), key)


def relations_from(texts: DataFrame) -> DataFrame:
    """Parsed relation rows from (doc_id, source, text)."""
    words = spread(texts, "doc_id").select(
        "doc_id", "source",
        F.split(F.btrim("text", F.lit(" \n\t\r")), "[ \\n\\t\\r]+").alias("all_w"),
    )
    # Each run keeps all its words: the last one also takes what is left over.
    runs = F.expr(
        f"""transform(sequence(0, greatest(1, size(all_w) div {RUN}) - 1), i ->
            slice(all_w, i * {RUN} + 1,
                  if(i = greatest(1, size(all_w) div {RUN}) - 1, size(all_w) - i * {RUN}, {RUN})))"""
    )
    cut = explode_once(words, ["doc_id", "source"], runs, "chunk", "w").where("w[0] <> ''")
    full = cut.withColumn(
        "w", F.expr("if(size(w) >= 6, w, transform(sequence(0, 5), i -> w[i % size(w)]))")
    )
    picked = full.selectExpr(
        "doc_id", "chunk", "source", "w",
        "CAST(length(get(w, 0)) % 3 AS INT) AS a",
        "CAST(3 + length(get(w, 1)) % 2 AS INT) AS b",
        "length(get(w, 2)) % 2 AS o",
    )
    spans = picked.selectExpr(
        "doc_id", "chunk", "source", "o", "array_join(w, ' ') AS sentence",
        "get(w, a) AS wa", "get(w, b) AS wb",
        "IF(a = 0, 0, length(array_join(slice(w, 1, a), ' ')) + 1) AS sa",
        "length(array_join(slice(w, 1, b), ' ')) + 1 AS sb",
    )
    entities = spans.selectExpr(
        f"""if(chunk < {RUNS_PER_DOC}, doc_id * {RUNS_PER_DOC} + chunk,
               raise_error(concat('too many runs in document ', doc_id))) AS id""", "doc_id", "chunk", "sentence", "source",
        "IF(o = 0, wa, wb) AS subject_entity", "IF(o = 0, wb, wa) AS object_entity",
        "CAST(IF(o = 0, sa, sb) AS INT) AS subject_start_idx",
        "CAST(IF(o = 0, sb, sa) AS INT) AS object_start_idx",
    )
    rows = entities.selectExpr(
        "id", "sentence", "source", "subject_entity", "subject_start_idx",
        "CAST(subject_start_idx + length(subject_entity) - 1 AS INT) AS subject_end_idx",
        "IF(length(subject_entity) % 2 = 0, 'PER', 'ORG') AS subject_type",
        "object_entity", "object_start_idx",
        "CAST(object_start_idx + length(object_entity) - 1 AS INT) AS object_end_idx",
        "element_at(array('PER', 'ORG', 'LOC', 'DAT', 'POH', 'NOH'),"
        " CAST(length(object_entity) % 6 AS INT) + 1) AS object_type",
        f"""CAST(CASE WHEN length(sentence) % 4 = 0 THEN 0
                 WHEN (doc_id + chunk) % 5 = 0 THEN (doc_id * 7 + chunk) % {NUM_LABELS}
                 ELSE (length(sentence) * 7) % {NUM_LABELS} END AS INT) AS label_num""",
    )
    names = F.array(*[F.lit(x) for x in LABELS])
    return rows.withColumn("label", F.element_at(names, F.col("label_num") + 1))


_prepared: dict[tuple[str, str], str] = {}
_lock = threading.Lock()


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared corpus: derived once per session, written to the shared folder, then read.

    Corpora are prepared once and read many times; readers get column pruning, pushed filters
    and as many splits as the files have.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        if key in _prepared:
            try:
                return spark.read.parquet(_prepared[key])
            except AnalysisException:
                pass  # the shared folder was cleared: prepare it again
        path = scratch_path(spark, "corpus")
        relations_from(table(spark, sf_dir, "documents")).write.parquet(path)
        _prepared[key] = path
    return spark.read.parquet(path)


def test_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unlabelled side of train/test comparisons, from the ``benchmark`` texts."""
    texts = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS doc_id", "'benchmark' AS source", "text"
    )
    return relations_from(texts).drop("label", "label_num")


def raw(rows: DataFrame) -> DataFrame:
    """Unparsed rows: the entity columns as dictionary literals in text."""

    def literal(role: str) -> str:
        return f"""concat('{{\\'word\\': "',
            replace(replace({role}_entity, '\\\\', '\\\\\\\\'), '"', '\\\\"'),
            '", \\'start_idx\\': ', {role}_start_idx, ', \\'end_idx\\': ', {role}_end_idx,
            ', \\'type\\': \\'', {role}_type, '\\'}}') AS {role}_entity"""

    return rows.selectExpr("id", "sentence", literal("subject"), literal("object"), "label", "source")


def scored(rows: DataFrame, run: int) -> DataFrame:
    """Probabilities of one scoring run over rows with ``id`` and ``label_num``."""
    weights = F.expr(
        f"""transform(sequence(0, {NUM_LABELS - 1}), c ->
            CAST(1 + (id * 31 + c * 17 + {run * 7}) % 97
                 + IF(c = label_num AND (id + {run}) % 3 <> 0, 97, 0) AS DOUBLE))"""
    )
    probs = let(weights, lambda w: let(total(w), lambda t: F.transform(w, lambda x: x / t)))
    return rows.withColumn("probs", probs)
