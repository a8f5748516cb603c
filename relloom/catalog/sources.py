"""Round trips through files: relation CSV, word lists, prediction runs, submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from relloom import rules
from relloom.catalog.base import LABEL_LIST, query, scored_cte, with_rel
from relloom.catalog.cleaning import DEDUP_RAW, PARSED_COLS, parsed
from relloom.catalog.scoring import ENSEMBLE, WEIGHTS, run_rows
from relloom.corpus import raw, relations, scored, test_relations
from relloom.operators.evaluate import predict_labels
from relloom.plans.prepare import ensemble_files, prepare_files
from relloom.session import scratch_path
from relloom.sources import relations as src
from relloom.sources import runs as rn


@query(
    "csv_round_trip",
    with_rel("SELECT id, sentence, source, label, subject_entity, object_entity FROM rel"),
)
def csv(spark, sf):
    path = scratch_path(spark, "relations")
    columns = [field.split()[0] for field in src.PARSED.split(", ")]
    src.write_relations(parsed(spark, sf).select(columns), path)
    return src.read_relations(spark, path, "parsed").select("id", "sentence", "source", "label", "subject_entity", "object_entity")


@query("prepare_files", with_rel(f"SELECT {PARSED_COLS} FROM raw_first", DEDUP_RAW))
def prepared(spark, sf):
    """Raw CSV files -> dedup -> parsed table, through files all the way."""
    base = scratch_path(spark, "prepare")
    src.write_relations(raw(relations(spark, sf)), f"{base}/train")
    tests = test_relations(spark, sf).withColumn("label", F.lit("100"))
    src.write_relations(raw(tests), f"{base}/test")
    prepare_files(spark, f"{base}/train", f"{base}/test", base)
    return spark.read.parquet(f"{base}/new_train").select(*PARSED_COLS.split(", "))


@query(
    "read_stop_words",
    with_rel("SELECT DISTINCT source AS word FROM rel"),
)
def stop_words(spark, sf):
    """One entry per row with a carriage return and blanks round it; read back trimmed and distinct."""
    path = scratch_path(spark, "words")
    lines = parsed(spark, sf).select(F.concat(F.lit("  "), "source", F.lit(" \r")).alias("value"))
    lines.write.text(path)
    return src.read_stop_words(spark, path)


@query(
    "label_dim",
    with_rel(
        f"""SELECT label_num, {LABEL_LIST}[label_num + 1] AS label, count(*) AS n FROM rel GROUP BY 1, 2"""
    ),
)
def labels(spark, sf):
    """Rows per dictionary entry, through the dictionary table."""
    dim = F.broadcast(rules.label_dim(spark))
    return relations(spark, sf).select("label").join(dim, "label").groupBy("label_num", "label").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "type_rules",
    with_rel(
        "SELECT subject_type, object_type, "
        + "CASE "
        + " ".join(
            f"WHEN subject_type = '{s}' AND object_type = '{o}' THEN '{','.join(map(str, a))}'"
            for (s, o), a in rules.TYPE_RULES.items()
        )
        + " END AS allowed, count(*) AS n FROM rel GROUP BY ALL"
    ),
)
def type_rules(spark, sf):
    """Rows per type pair with the pair's rule, through the rule table written and read back."""
    path = scratch_path(spark, "rules")
    rules.type_rules(spark).write.parquet(path)
    table = spark.read.parquet(path).select(
        "subject_type", "object_type", F.array_join("allowed", ",").alias("allowed")
    )
    counts = parsed(spark, sf).groupBy("subject_type", "object_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(table, ["subject_type", "object_type"])


def _write_runs(spark, sf) -> str:
    """One folder of prediction files whose names hold the run's score."""
    base = scratch_path(spark, "runs")
    rows = relations(spark, sf).select("id", "label_num")
    for run, weight in WEIGHTS.items():
        part = predict_labels(scored(rows, run)).select("id", "pred_label", "probs")
        rn.write_submission(part, base, f"run{run}_epoch={run}_{weight}_f1={weight}")
    return base


@query(
    "read_runs",
    with_rel(
        " UNION ALL ".join(
            f"""SELECT '{run}' AS run_no, CAST({weight} AS DOUBLE) AS weight, '{weight}' AS checkpoint_score, id,
                  list_position(probs, list_max(probs)) - 1 AS best, round(list_sum(probs), 9) AS total FROM run{run}"""
            for run, weight in WEIGHTS.items()
        ),
        *[scored_cte(run, f"run{run}") for run in WEIGHTS],
    ),
)
def runs(spark, sf):
    """Prediction files written as CSV with list text, read back and parsed."""
    rows = rn.read_runs(spark, _write_runs(spark, sf), layout="folders")
    return rows.select(
        F.regexp_extract("run", "^run([0-9])", 1).alias("run_no"), "weight",
        "checkpoint_score", "id",
        (F.array_position("probs", F.array_max("probs")) - 1).alias("best"),
        F.round(F.aggregate("probs", F.lit(0.0), lambda s, x: s + x), 9).alias("total"),
    )


@query(
    "ensemble_files",
    with_rel(
        f"""SELECT id, {LABEL_LIST}[list_position(r, list_max(r))] AS pred_label, round(list_max(r), 6) AS top
            FROM (SELECT id, list_transform(probs, lambda p: round(p, 12)) AS r FROM mean)""",
        ENSEMBLE,
    ),
)
def ensemble_of_files(spark, sf):
    """A folder of runs, weights in their names, to one table of labels."""
    rows = ensemble_files(spark, _write_runs(spark, sf), layout="folders", expected=len(WEIGHTS))
    return rows.select("id", "pred_label", F.round(F.array_max("probs"), 6).alias("top"))


@query(
    "submission",
    with_rel(
        f"""SELECT id, {LABEL_LIST}[list_position(probs, list_max(probs))] AS pred_label,
              round(list_max(probs), 9) AS top FROM scored""",
        scored_cte(1),
    ),
)
def submission(spark, sf):
    """Predictions put into the sample file by id, written and read back."""
    base = scratch_path(spark, "submission")
    sample = parsed(spark, sf).select("id", F.lit("").alias("pred_label"), F.lit("").alias("probs"))
    out = rn.submission(sample, predict_labels(run_rows(spark, sf)))
    rn.write_submission(out, base, "last")
    rows = spark.read.schema(rn.PREDICTIONS).option("header", True).option("escape", '"').csv(base)
    return rows.select("id", "pred_label", F.round(F.array_max(rn.parse_probs()), 9).alias("top"))
