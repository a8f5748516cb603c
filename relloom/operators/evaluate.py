"""Scoring tables: predictions, metrics, confusion counts, loss and rule audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relloom import rules
from relloom.functions.arrays import argmax, explode_once, let, log_sum_exp, softmax, total
from relloom.operators.parse import decode_labels
from relloom.operators.ranking import running_totals


def add_probs(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("probs", softmax(F.col(logits)))


def predict_labels(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Add ``pred`` (number of the first largest probability) and ``pred_label``."""
    return decode_labels(df.withColumn("pred", argmax(F.col(probs))), "pred", "pred_label")


def score(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """Apply a caller's model: batch of ``columns`` in, one logits list per row out."""
    schema = df.select("*", F.lit(None).cast("array<double>").alias("logits")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(logits=fn(batch[columns]))

    return df.mapInPandas(run, schema)


def _f1_terms(pred: Column, label: Column) -> tuple[Column, Column, Column]:
    hit = F.count_if((pred == label) & (label != 0))
    false = F.count_if((pred != 0) & (pred != label))
    missed = F.count_if((label != 0) & (pred != label))
    return hit, false, missed


def _f1(pred: Column, label: Column) -> Column:
    hit, false, missed = _f1_terms(pred, label)
    return F.coalesce(F.try_divide(hit * 200.0, hit * 2 + false + missed), F.lit(0.0))


def micro_f1(df: DataFrame, pred: str = "pred", label: str = "label_num") -> DataFrame:
    """Micro-F1 over all labels but no_relation, times 100."""
    hit, false, missed = _f1_terms(F.col(pred), F.col(label))
    return df.agg(
        hit.alias("tp"), false.alias("fp"), missed.alias("fn"),
        _f1(F.col(pred), F.col(label)).alias("micro_f1"),
    )


def class_auprc(df: DataFrame, probs: str = "probs", label: str = "label_num") -> DataFrame:
    """Area under the precision-recall curve of each class against the rest.

    Equal scores of a class are one point of its curve; the points, not the rows, are
    cumulated, and a class with many points is spread over tasks.
    """
    points = (
        explode_once(df, [label], F.col(probs), "c", "p")
        .groupBy("c", "p")
        .agg(F.count_if(F.col(label) == F.col("c")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    curve = running_totals(
        points, ["c"], [F.col("p").desc()], {"tp": F.col("pos"), "seen": F.col("n")}
    )
    # Point before this one; before the first one precision is 1.
    seen_before, tp_before = F.col("seen") - F.col("n"), F.col("tp") - F.col("pos")
    before = F.when(seen_before == 0, F.lit(1.0)).otherwise(F.try_divide(tp_before, seen_before))
    step = F.try_divide(F.col("pos"), F.col("tp_total"))
    area = step * (F.col("tp") / F.col("seen") + before) / 2
    # Without positives there is no recall: the class scores 0.
    return curve.groupBy("c").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("auprc"))


def score_histogram(df: DataFrame, bins: int, probs: str = "probs", label: str = "label_num") -> DataFrame:
    """(c, bin, pos, n): rows of each class by score, positives among them.

    Bins have equal widths of the score's square root, so small scores, as most are, get narrow
    ones. Histograms of the same ``bins`` merge by adding counts: tasks send one row per class and
    bin, whatever they read.
    """
    at = F.floor(F.sqrt(F.greatest(F.col("p"), F.lit(0.0))) * bins)
    return (
        explode_once(df, [label], F.col(probs), "c", "p")
        .groupBy("c", F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count_if(F.col(label) == F.col("c")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )


def binned_auprc(histogram: DataFrame) -> DataFrame:
    """(c, auprc, low, high) from ``score_histogram``: the exact area lies in [low, high].

    A bin is one point of the curve. Whatever the order of the rows inside a bin, precision
    there is no less than after all its negatives and before its positives, and no more than after
    its positives alone; recall grows by its positives. Of each class, ``bins`` rows are cumulated.
    """
    whole = W.partitionBy("c")
    upto = whole.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    curve = histogram.withColumns(
        {"tp": F.sum("pos").over(upto), "seen": F.sum("n").over(upto), "positives": F.sum("pos").over(whole)}
    )
    tp0, seen0 = F.col("tp") - F.col("pos"), F.col("seen") - F.col("n")
    before = F.when(seen0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, seen0))
    step = F.try_divide(F.col("pos"), F.col("positives"))
    worst = F.coalesce(F.try_divide(tp0, F.col("seen") - F.col("pos")), F.lit(1.0))
    best = F.coalesce(F.try_divide(F.col("tp"), seen0 + F.col("pos")), F.lit(1.0))
    areas = {"auprc": (F.col("tp") / F.col("seen") + before) / 2, "low": worst, "high": best}
    return curve.groupBy("c").agg(*[F.coalesce(F.sum(step * v), F.lit(0.0)).alias(k) for k, v in areas.items()])


def auprc(df: DataFrame, probs: str = "probs", label: str = "label_num", bins: int | None = None) -> DataFrame:
    """Mean class area times 100; every class counts.

    With ``bins`` the scores are counted, not sorted, and ``low`` and ``high`` bound the exact mean.
    """
    if bins is None:
        return class_auprc(df, probs, label).agg((F.avg("auprc") * 100).alias("auprc"))
    areas = binned_auprc(score_histogram(df, bins, probs, label))
    return areas.agg(*[(F.avg(c) * 100).alias(c) for c in ("auprc", "low", "high")])


def accuracy(df: DataFrame, pred: str = "pred", label: str = "label_num") -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("int")).alias("accuracy"))


def evaluate(df: DataFrame, probs: str = "probs", label: str = "label_num", bins: int | None = None) -> DataFrame:
    """Micro-F1, AUPRC (binned, if asked for) and accuracy of a scored table, in one row."""
    rows = df.withColumn("pred", argmax(F.col(probs)))
    area = auprc(df, probs, label, bins).select("auprc").scalar()
    hits = (F.col("pred") == F.col(label)).cast("int")
    return rows.agg(
        _f1(F.col("pred"), F.col(label)).alias("micro_f1"), F.avg(hits).alias("accuracy")
    ).withColumn("auprc", area)


def confusion(df: DataFrame, pred: str = "pred", label: str = "label_num") -> DataFrame:
    """Counts of (true, predicted) over all labels seen in either, zeros included.

    The counts have at most one row per pair of labels, so they fit one row as a map.
    """
    counts = df.groupBy(F.col(label).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("t", "p"), "n"))).alias("m"),
        F.array_sort(F.array_union(F.collect_set("t"), F.collect_set("p"))).alias("seen"),
    )
    dense = whole.select("m", "seen", F.explode("seen").alias("t")).select(
        "m", "t", F.explode("seen").alias("p")
    )
    n = F.coalesce(F.col("m")[F.struct("t", "p")], F.lit(0))
    return dense.select(F.col("t").alias("true_label"), F.col("p").alias("pred_label"), n.alias("n"))


def _allowed() -> Column:
    pairs = [
        x
        for (s, o), allowed in rules.TYPE_RULES.items()
        for x in (F.lit(f"{s} {o}"), F.array(*[F.lit(a) for a in allowed]))
    ]
    return F.create_map(*pairs)[F.concat_ws(" ", "subject_type", "object_type")]


def _invalid() -> Column:
    """Label numbers the type pair does not allow; NULL for a pair without a rule."""
    return F.array_except(F.sequence(F.lit(0), F.lit(rules.NUM_LABELS - 1)), _allowed())


def rule_violations(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Add the labels a row's types rule out, and whether the prediction is one of them."""
    return df.withColumns(
        {"invalid": _invalid(), "breaks_rule": ~F.array_contains(_allowed(), F.col(pred))}
    )


def violation_share(df: DataFrame, pred: str = "pred") -> DataFrame:
    flagged = rule_violations(df, pred)
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("breaks_rule").alias("violations"),
        F.avg(F.col("breaks_rule").cast("int")).alias("share"),
    )


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    """-log p[label]; smoothing spreads its share over all classes."""
    hit = log_sum_exp(logits) - F.get(logits, label)
    if not smoothing:
        return hit
    every = let(log_sum_exp(logits), lambda z: total(F.transform(logits, lambda x: z - x)))
    return (1 - smoothing) * hit + smoothing / rules.NUM_LABELS * every


def focal(logits: Column, label: Column, alpha: float = 0.5, gamma: float = 2.0) -> Column:
    return let(
        cross_entropy(logits, label),
        lambda ce: alpha * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce,
    )


def adaptive_threshold(logits: Column, label: Column) -> Column:
    """Class 0 is the threshold a true relation must pass and all others must stay below."""
    zero, own = F.get(logits, F.lit(0)), F.get(logits, label)
    above = F.when(label == 0, F.lit(0.0)).otherwise(log_sum_exp(F.array(zero, own)) - own)
    rest = F.filter(logits, lambda x, i: (i == 0) | (i != label))
    return above + log_sum_exp(rest) - zero


def rule_penalty(logits: Column, label: Column) -> Column:
    """Binary cross-entropy summed over the labels the types rule out."""
    invalid = F.transform(
        _invalid(),
        lambda c: let(
            F.get(logits, c),
            lambda x: F.greatest(x, F.lit(0.0))
            - F.when(c == label, x).otherwise(0.0)
            + F.log1p(F.exp(-F.abs(x))),
        ),
    )
    return total(invalid) / rules.NUM_LABELS


def loss_audit(
    df: DataFrame,
    kind: str,
    logits: str = "logits",
    label: str = "label_num",
    smoothing: float = 0.0,
    alpha: float = 0.5,
    gamma: float = 2.0,
    penalty_scale: float = 1.0,
) -> DataFrame:
    """Mean loss of a scored table: ce, focal, threshold, penalty, or focal_penalty."""
    x, y = F.col(logits), F.col(label)
    losses = {
        "ce": lambda: cross_entropy(x, y, smoothing),
        "focal": lambda: focal(x, y, alpha, gamma),
        "threshold": lambda: adaptive_threshold(x, y),
        "penalty": lambda: rule_penalty(x, y),
        "focal_penalty": lambda: focal(x, y, alpha, gamma) + penalty_scale * rule_penalty(x, y),
    }
    if kind not in losses:
        raise ValueError(f"unknown loss {kind!r}")
    return df.agg(F.avg(losses[kind]()).alias("loss"))


def _both_runs(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """(id, p, q): the column of both runs; an id of only one run is an error."""
    rows = one.select("id", F.col(column).alias("p")).join(two.select("id", F.col(column).alias("q")), "id", "full")
    lost = F.raise_error(F.concat(F.lit("only one run has id "), F.col("id").cast("string")))
    return rows.withColumn("p", F.when(F.col("p").isNull() | F.col("q").isNull(), lost).otherwise(F.col("p")))


def run_divergence(one: DataFrame, two: DataFrame, probs: str = "probs") -> DataFrame:
    """Symmetric mean of the two divergences between scoring runs, summed over rows.

    A class that both runs give 0 adds nothing, one that only one of them does makes the sum infinite.
    An id that only one run has is an error.
    """
    rows = _both_runs(one, two, probs)

    def part(p: Column, q: Column) -> Column:
        one_zero = (p == 0) | (q == 0)
        return F.when(p == q, 0.0).when(one_zero, float("inf")).otherwise((p - q) * (F.log(p) - F.log(q)))

    parts = F.zip_with("p", "q", part)
    return rows.agg((F.sum(total(parts)) / 2).alias("divergence"))


def logit_divergence(one: DataFrame, two: DataFrame, logits: str = "logits") -> DataFrame:
    """``run_divergence`` from logits: log-probabilities are logits less their log-sum-exp.

    No probability is divided or logged, so one too small for a double still counts with its
    logarithm. Logits of minus infinity are probabilities of exactly 0, as in ``run_divergence``.
    """
    rows = _both_runs(one, two, logits)

    def logs(x: str) -> Column:
        return let(log_sum_exp(F.col(x)), lambda z: F.transform(x, lambda v: v - z))

    never = F.lit(float("-inf"))

    def part(a: Column, b: Column) -> Column:
        one_zero = (a == never) | (b == never)
        return F.when(a == b, 0.0).when(one_zero, float("inf")).otherwise((F.exp(a) - F.exp(b)) * (a - b))

    return rows.agg((F.sum(total(F.zip_with(logs("p"), logs("q"), part))) / 2).alias("divergence"))
