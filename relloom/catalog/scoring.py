"""Predictions, metrics, audits, ensembles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom import rules
from relloom.catalog.base import LABEL_LIST, query, scored_cte, with_rel
from relloom.corpus import relations, scored
from relloom.functions.arrays import explode_once
from relloom.operators import ensemble as en
from relloom.operators import evaluate as ev

SCORED = scored_cte(1)
PRED = """preds AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS pred FROM scored)"""
LAST = rules.NUM_LABELS - 1
RULES = " UNION ALL ".join(
    f"SELECT '{s}' AS subject_type, '{o}' AS object_type, {allowed} AS allowed"
    for (s, o), allowed in rules.TYPE_RULES.items()
)
LOGITS = "logit AS (SELECT *, list_transform(probs, lambda p: ln(p)) AS x FROM scored)"
LSE = "ln(list_sum(list_transform(x, lambda v: exp(v))))"


def run_rows(spark, sf, run: int = 1) -> DataFrame:
    rows = relations(spark, sf).select("id", "label_num", "subject_type", "object_type")
    return scored(rows, run)


def predicted(spark, sf) -> DataFrame:
    return ev.predict_labels(run_rows(spark, sf))


def logits(spark, sf) -> DataFrame:
    return run_rows(spark, sf).withColumn("logits", F.transform("probs", lambda p: F.log(p)))


@query("predict_labels", with_rel(f"SELECT id, pred, {LABEL_LIST}[pred + 1] AS pred_label FROM preds", SCORED, PRED))
def predict(spark, sf):
    return predicted(spark, sf).select("id", "pred", "pred_label")


@query(
    "softmax",
    with_rel(
        """SELECT id, CAST(c AS INT) AS c, round(p, 9) AS p FROM (
             SELECT id, unnest(range(0, 30)) AS c, unnest(probs) AS p FROM scored)""",
        SCORED,
    ),
)
def softmaxed(spark, sf):
    """Softmax of the logits gives the probabilities back."""
    rows = ev.add_probs(logits(spark, sf))
    return explode_once(rows, ["id"], F.col("probs"), "c", "p").withColumn("p", F.round("p", 9))


F1 = """f1 AS (SELECT count(*) FILTER (pred = label_num AND label_num <> 0) AS tp,
  count(*) FILTER (pred <> 0 AND pred <> label_num) AS fp,
  count(*) FILTER (label_num <> 0 AND pred <> label_num) AS fn FROM preds)"""


@query(
    "micro_f1",
    with_rel("SELECT tp, fp, fn, round(200.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS micro_f1 FROM f1", SCORED, PRED, F1),
)
def f1(spark, sf):
    return ev.micro_f1(predicted(spark, sf)).withColumn("micro_f1", F.round("micro_f1", 9))


AUPRC = """
points AS (
  SELECT c, p, count(*) FILTER (label_num = c) AS pos, count(*) AS n
  FROM (SELECT label_num, unnest(range(0, 30)) AS c, unnest(probs) AS p FROM scored) GROUP BY c, p
), curve AS (
  SELECT c, p, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY c) AS total
  FROM points WINDOW w AS (PARTITION BY c ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
), steps AS (
  SELECT c, tp / total::DOUBLE AS r, tp / seen::DOUBLE AS pr,
    coalesce(lag(tp / total::DOUBLE) OVER w, 0) AS r0, coalesce(lag(tp / seen::DOUBLE) OVER w, 1) AS pr0
  FROM curve WINDOW w AS (PARTITION BY c ORDER BY p DESC)
), areas AS (
  SELECT CAST(c AS INT) AS c, coalesce(sum(CASE WHEN isnan(r) OR isinf(r) THEN NULL ELSE (r - r0) * (pr + pr0) / 2 END), 0) AS auprc
  FROM steps GROUP BY c
)"""


@query("class_auprc", with_rel("SELECT c, round(auprc, 9) AS auprc FROM areas", SCORED, AUPRC))
def class_auprc(spark, sf):
    return ev.class_auprc(run_rows(spark, sf)).withColumn("auprc", F.round("auprc", 9))


@query("auprc", with_rel("SELECT round(avg(auprc) * 100, 8) AS auprc FROM areas", SCORED, AUPRC))
def auprc(spark, sf):
    return ev.auprc(run_rows(spark, sf)).withColumn("auprc", F.round("auprc", 8))


BINS = 256
BINNED = f"""
points AS (
  SELECT c, least(floor(sqrt(p) * {BINS}), {BINS - 1}) AS bin, count(*) FILTER (label_num = c) AS pos, count(*) AS n
  FROM (SELECT label_num, unnest(range(0, 30)) AS c, unnest(probs) AS p FROM scored) GROUP BY c, bin
), curve AS (
  SELECT c, bin, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY c) AS total
  FROM points WINDOW w AS (PARTITION BY c ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)
), areas AS (
  SELECT CAST(c AS INT) AS c,
    coalesce(sum(pos / nullif(total, 0)::DOUBLE * (tp / seen::DOUBLE
      + CASE WHEN seen = n THEN 1 ELSE (tp - pos) / (seen - n)::DOUBLE END) / 2), 0) AS auprc,
    coalesce(sum(pos / nullif(total, 0)::DOUBLE * coalesce((tp - pos) / nullif(seen - pos, 0)::DOUBLE, 1)), 0) AS low,
    coalesce(sum(pos / nullif(total, 0)::DOUBLE * coalesce(tp / nullif(seen - n + pos, 0)::DOUBLE, 1)), 0) AS high
  FROM curve GROUP BY c
)"""


@query(
    "class_auprc_binned",
    with_rel(
        "SELECT c, round(auprc, 9) AS auprc, round(low, 9) AS low, round(high, 9) AS high FROM areas", SCORED, BINNED
    ),
)
def binned(spark, sf):
    areas = ev.binned_auprc(ev.score_histogram(run_rows(spark, sf), BINS))
    return areas.select("c", *[F.round(x, 9).alias(x) for x in ("auprc", "low", "high")])


@query(
    "auprc_binned",
    with_rel(
        """SELECT round(avg(auprc) * 100, 8) AS auprc, round(avg(low) * 100, 8) AS low, round(avg(high) * 100, 8) AS high,
             (SELECT avg(auprc) FROM exact_areas) BETWEEN avg(low) AND avg(high) AS holds FROM areas""",
        SCORED, AUPRC.replace("points AS", "exact_points AS").replace("FROM points", "FROM exact_points")
        .replace("curve AS", "exact_curve AS").replace("FROM curve", "FROM exact_curve").replace("areas AS", "exact_areas AS"),
        BINNED,
    ),
)
def mean_binned(spark, sf):
    """The binned mean with its bounds, and whether the exact mean lies between them."""
    exact = ev.auprc(run_rows(spark, sf)).scalar()
    out = ev.auprc(run_rows(spark, sf), bins=BINS).withColumn("holds", exact.between(F.col("low"), F.col("high")))
    return out.select(*[F.round(x, 8).alias(x) for x in ("auprc", "low", "high")], "holds")


@query(
    "accuracy",
    with_rel("SELECT round(avg(CASE WHEN pred = label_num THEN 1 ELSE 0 END), 9) AS accuracy FROM preds", SCORED, PRED),
)
def accuracy(spark, sf):
    return ev.accuracy(predicted(spark, sf)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "evaluate",
    with_rel(
        """SELECT round(200.0::DOUBLE * tp / (2 * tp + fp + fn), 8) AS micro_f1,
             round((SELECT avg(CASE WHEN pred = label_num THEN 1 ELSE 0 END) FROM preds), 8) AS accuracy,
             round((SELECT avg(auprc) * 100 FROM areas), 8) AS auprc FROM f1""",
        SCORED, PRED, F1, AUPRC,
    ),
)
def bundle(spark, sf):
    out = ev.evaluate(run_rows(spark, sf))
    return out.select(*[F.round(c, 8).alias(c) for c in ("micro_f1", "accuracy", "auprc")])


@query(
    "confusion",
    with_rel(
        """SELECT t.l AS true_label, p.l AS pred_label, count(preds.id) AS n
           FROM seen t CROSS JOIN seen p LEFT JOIN preds ON preds.label_num = t.l AND preds.pred = p.l
           GROUP BY t.l, p.l""",
        SCORED, PRED, "seen AS (SELECT label_num AS l FROM preds UNION SELECT pred FROM preds)",
    ),
)
def confusion(spark, sf):
    return ev.confusion(predicted(spark, sf))


@query(
    "rule_violations",
    with_rel(
        """SELECT id, array_to_string(list_filter(range(0, 30), lambda c: NOT list_contains(allowed, c)), ',') AS invalid,
             NOT list_contains(allowed, pred) AS breaks_rule
           FROM preds JOIN rules USING (subject_type, object_type)""",
        SCORED, PRED, f"rules AS ({RULES})",
    ),
)
def violations(spark, sf):
    rows = ev.rule_violations(predicted(spark, sf))
    return rows.select("id", F.array_join("invalid", ",").alias("invalid"), "breaks_rule")


@query(
    "violation_share",
    with_rel(
        """SELECT count(*) AS rows, count(*) FILTER (NOT list_contains(allowed, pred)) AS violations,
             round(avg(CASE WHEN list_contains(allowed, pred) THEN 0 ELSE 1 END), 9) AS share
           FROM preds JOIN rules USING (subject_type, object_type)""",
        SCORED, PRED, f"rules AS ({RULES})",
    ),
)
def violation_share(spark, sf):
    return ev.violation_share(predicted(spark, sf)).withColumn("share", F.round("share", 9))


CE = f"({LSE} - x[label_num + 1])"
PENALTY = """list_sum(list_transform(range(0, 30), lambda c: CASE WHEN list_contains(allowed, c) THEN 0 ELSE
  greatest(x[c + 1], 0) - CASE WHEN c = label_num THEN x[c + 1] ELSE 0 END + ln(1 + exp(-abs(x[c + 1]))) END)) / 30"""
LOSSES = {
    "ce": CE,
    "focal": f"0.5 * pow(1 - exp(-{CE}), 2) * {CE}",
    "threshold": """CASE WHEN label_num = 0 THEN 0 ELSE ln(exp(x[1]) + exp(x[label_num + 1])) - x[label_num + 1] END
      + ln(list_sum(list_transform(range(0, 30), lambda c: CASE WHEN c = 0 OR c <> label_num THEN exp(x[c + 1]) ELSE 0 END))) - x[1]""",
    "penalty": PENALTY,
    "focal_penalty": f"0.5 * pow(1 - exp(-{CE}), 2) * {CE} + {PENALTY}",
}

for _kind, _sql in LOSSES.items():

    @query(
        f"loss_{_kind}",
        with_rel(
            f"SELECT round(avg({_sql}), 8) AS loss FROM logit JOIN rules USING (subject_type, object_type)",
            SCORED, LOGITS, f"rules AS ({RULES})",
        ),
    )
    def _loss(spark, sf, kind=_kind):
        return ev.loss_audit(logits(spark, sf), kind).withColumn("loss", F.round("loss", 8))


@query(
    "loss_smoothed",
    with_rel(
        f"SELECT round(avg(0.9 * {CE} + 0.1 / 30 * (30 * {LSE} - list_sum(x))), 8) AS loss FROM logit",
        SCORED, LOGITS,
    ),
)
def smoothed(spark, sf):
    return ev.loss_audit(logits(spark, sf), "ce", smoothing=0.1).withColumn("loss", F.round("loss", 8))


@query(
    "run_divergence",
    with_rel(
        """SELECT round(sum((p - q) * (ln(p) - ln(q))) / 2, 6) AS divergence FROM (
             SELECT unnest(a.probs) AS p, unnest(b.probs) AS q FROM scored a JOIN scored2 b USING (id))""",
        SCORED, scored_cte(2, "scored2"),
    ),
)
def divergence(spark, sf):
    out = ev.run_divergence(run_rows(spark, sf, 1), run_rows(spark, sf, 2))
    return out.withColumn("divergence", F.round("divergence", 6))


@query(
    "logit_divergence",
    with_rel(
        """SELECT round(sum((exp(a) - exp(b)) * (a - b)) / 2, 6) AS divergence FROM (
             SELECT unnest(list_transform(u, lambda v: v - ln(list_sum(list_transform(u, lambda w: exp(w)))))) AS a,
               unnest(list_transform(o, lambda v: v - ln(list_sum(list_transform(o, lambda w: exp(w)))))) AS b
             FROM (SELECT list_transform(x.probs, lambda p: ln(p) + 3) AS u, list_transform(y.probs, lambda p: 2 * ln(p)) AS o
                   FROM scored x JOIN scored2 y USING (id)))""",
        SCORED, scored_cte(2, "scored2"),
    ),
)
def divergence_of_logits(spark, sf):
    """Two runs by their logits: the first one's are shifted, the second one's are sharpened."""
    one = run_rows(spark, sf, 1).withColumn("logits", F.transform("probs", lambda p: F.log(p) + 3))
    two = run_rows(spark, sf, 2).withColumn("logits", F.transform("probs", lambda p: F.log(p) * 2))
    out = ev.logit_divergence(one, two)
    return out.withColumn("divergence", F.round("divergence", 6))


# Leaderboard scores of three runs.
WEIGHTS = {1: 86.0, 2: 87.5, 3: 84.25}


def all_runs(spark, sf) -> DataFrame:
    """All runs of one scan: each row is scored by every run."""
    rows = relations(spark, sf).select("id", "label_num")
    out = None
    for run, weight in WEIGHTS.items():
        part = scored(rows, run).withColumns({"run": F.lit(run), "weight": F.lit(weight)})
        out = part if out is None else out.unionByName(part)
    return out


ENSEMBLE = ",".join(
    [scored_cte(run, f"run{run}") for run in WEIGHTS]
) + """, mean AS (
  SELECT a.id, list_transform(range(1, 31), lambda c:
    (86.0::DOUBLE * a.probs[c] + 87.5::DOUBLE * b.probs[c] + 84.25::DOUBLE * d.probs[c]) / 257.75::DOUBLE) AS probs
  FROM run1 a JOIN run2 b USING (id) JOIN run3 d USING (id)
)"""


@query(
    "ensemble",
    with_rel(
        """SELECT id, CAST(c AS INT) AS c, round(p, 9) AS p
           FROM (SELECT id, unnest(range(0, 30)) AS c, unnest(probs) AS p FROM mean)""",
        ENSEMBLE,
    ),
)
def mean_probs(spark, sf):
    rows = en.ensemble(all_runs(spark, sf))
    return explode_once(rows, ["id"], F.col("probs"), "c", "p").withColumn("p", F.round("p", 9))


@query(
    "check_probs",
    with_rel("SELECT id, abs(list_sum(probs) - 1) < 1e-6 AS ok FROM mean", ENSEMBLE),
)
def checked(spark, sf):
    rows = en.check_probs(en.ensemble(all_runs(spark, sf)))
    return rows.select("id", (F.size("probs") == rules.NUM_LABELS).alias("ok"))


@query(
    "ensemble_submission",
    with_rel(
        f"""SELECT id, {LABEL_LIST}[list_position(r, list_max(r))] AS pred_label, round(list_max(r), 6) AS top
            FROM (SELECT id, list_transform(probs, lambda p: round(p, 12)) AS r FROM mean)""",
        ENSEMBLE,
    ),
)
def submission(spark, sf):
    rows = en.ensemble_submission(all_runs(spark, sf))
    return rows.select("id", "pred_label", F.round(F.array_max("probs"), 6).alias("top"))


def type_model(batch: pd.DataFrame) -> pd.Series:
    """Stand-in for a caller's model: logits from the length of the sentence."""
    classes = np.arange(rules.NUM_LABELS)
    lengths = batch["sentence"].str.len().to_numpy()[:, None]
    return pd.Series(list(((lengths * 7 + classes * 11) % 31).astype("float64")), index=batch.index)


@query(
    "score_with_model",
    with_rel(
        """SELECT id, CAST(list_position(x, list_max(x)) - 1 AS INT) AS pred FROM (
             SELECT id, list_transform(range(0, 30), lambda c: (length(sentence) * 7 + c * 11) % 31) AS x FROM rel)"""
    ),
)
def with_model(spark, sf):
    rows = relations(spark, sf).select("id", "sentence")
    return ev.predict_labels(ev.score(rows, type_model, ["sentence"]), "logits").select("id", "pred")
