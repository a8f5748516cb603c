"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained with numpy from confirmed toxic documents and from unlabelled ones, of
which a share ``prior`` is toxic too. With the logistic loss l, the risk is

    prior * mean_P l(f, +1) + max(0, mean_U l(f, -1) - prior * mean_P l(f, -1))

whose second part estimates the risk on clean documents and is kept from going below zero; where it
does, its gradient is turned around (as Kiryo et al. propose).

Features are the presence of words and of byte runs (``GRAMS``) of the lower-cased text, hashed to
``2 ** BITS`` places. Those ``FEATURES`` places are used that are most over-represented among the
toxic documents of the training sample.

The training sample is bounded: about ``SAMPLE`` toxic and ``SAMPLE`` unlabelled documents, chosen by
a hash of their id and each text once, both only from rows whose crc32 of the id is not 2 modulo 4. The unlabelled ones
are read without their labels. The prior is the toxic share of the labelled rows of those same
folds. Every document is scored on its whole text, by text alone.

Null and empty texts have no features and get the score of the bias. Labels other than 0 and 1, and
null ones, are not used; without toxic examples the score is 0 everywhere. Rows with the same id are
scored each on its own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.llm import text as T
from relloom.session import materialise

BITS = 20
GRAMS = (4, 6, 8)
SAMPLE = 8000
FEATURES = 6000
#: A feature must be in this share of the toxic examples.
LEAST_SHARE = 0.02
EPOCHS = 300
DECAY = 3e-3
THRESHOLD = 0.3
TASKS = 8

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of all words and byte runs of a slice; runs do not cross rows."""
    low = T.LOWER[raw]
    starts, ends, first, h = T.lower_words(raw, at, T.ALNUM)
    shift = np.uint64(64 - BITS)
    places = [(h >> shift).astype(np.int32)]
    rows = [np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(first))]
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    padded = np.zeros(len(low) + 8, dtype=np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray(shape=(len(low) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))[: len(low)]
    left = at[1:][row] - np.arange(len(low)) if len(low) else np.empty(0, np.int64)
    for n in GRAMS:
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - 8 * n)
        hashed = ((((eight & keep) * _SPREAD) ^ np.uint64(n)) * _SPREAD >> shift).astype(np.int32)
        whole = left >= n
        places.append(hashed[whole])
        rows.append(row[whole])
    return np.concatenate(places), np.concatenate(rows)


def _chosen(raw: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of the chosen feature), each pair once."""
    places, rows = features(raw, at)
    k = chosen[places]
    hit = k >= 0
    pair = np.unique(rows[hit].astype(np.int64) * FEATURES + k[hit])
    return pair // FEATURES, pair % FEATURES


def train(x: list[np.ndarray], toxic: np.ndarray, prior: float, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias; ``x``: feature indices of each example, ``toxic``: confirmed, else unlabelled."""
    row = np.repeat(np.arange(len(x)), [len(f) for f in x])
    col = np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
    n_p, n_u = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        f = np.bincount(row, w[col], len(x)) + w[size]
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        loss_neg = np.logaddexp(0, f)
        clean = loss_neg[~toxic].sum() / n_u - prior * loss_neg[toxic].sum() / n_p
        up = np.where(toxic, -prior * (1 - p) / n_p, 0.0)  # gradient of the first part
        down = np.where(toxic, -prior * p / n_p, p / n_u)  # and of the second
        g = up + down if clean >= 0 else -down
        grad = np.append(np.bincount(col, g[row], size), g.sum())
        grad[:size] += DECAY * w[:size] / np.sqrt(size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:size], float(w[size])


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4))


def _share(rows: DataFrame, most: int) -> Column:
    """A condition that about ``most`` rows pass, chosen by a hash of the id."""
    n = rows.count()
    return F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))


class Model:
    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float | None):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        if self.bias is None:
            return np.zeros(n)
        row, k = _chosen(raw, at, self.chosen)
        f = np.bincount(row, self.weights[k], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labels and texts of the folds it may learn from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(fold(F.col("id")) != 2)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    known = known.where((fold(F.col("id")) != 2) & F.col("y").isin(0, 1))
    sums = known.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    none = Model(np.empty(0, np.int64), np.empty(0), None)
    if not sums.toxic:
        return none
    prior = min(max(sums.toxic / sums.n, 1e-4), 0.9)
    toxic = known.where("y = 1").select("id").distinct()
    toxic = materialise(toxic.where(_share(toxic, SAMPLE)))
    confirmed = rows.join(toxic, "id", "left_semi").select("text", F.lit(True).alias("toxic"))
    unlabelled = rows.where(_share(rows.select("id"), SAMPLE)).select("text", F.lit(False).alias("toxic"))
    sample = materialise(confirmed.unionByName(unlabelled).dropDuplicates(["text", "toxic"]).repartition(TASKS, F.xxhash64("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            for first, n, raw, at in T.slices(batch, "text"):
                places, of = features(raw, at)
                pair = np.unique(of.astype(np.int64) << BITS | places)
                which = flags[first : first + n][pair >> BITS]
                for k in (0, 1):
                    total[k] += np.bincount((pair & (1 << BITS) - 1)[which == bool(k)], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(total[1])
        yield pa.record_batch(
            [pa.array(some.astype(np.int64)), pa.array(total[1][some]), pa.array(total[0][some])], names=["place", "p", "u"]
        )

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_p, n_u = n.get(True, 0), n.get(False, 0)
    if not n_p:
        return none
    found = sample.mapInArrow(count, "place bigint, p int, u int").groupBy("place").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate_p, rate_u = F.col("p") / n_p, (F.col("u") + 1) / (n_u + 1)
    gain = (rate_p - rate_u) / F.sqrt(rate_u)
    best = found.where(F.col("p") >= max(3.0, LEAST_SHARE * n_p)).where(rate_p > 1.5 * rate_u).orderBy(gain.desc(), "place").limit(FEATURES)
    places = np.array([r.place for r in best.select("place").collect()], dtype=np.int64)
    chosen = np.full(1 << BITS, -1, dtype=np.int32)
    chosen[places] = np.arange(len(places), dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, n, raw, at in T.slices(batch, "text"):
                row, k = _chosen(raw, at, shared.value)
                out += np.split(k, np.searchsorted(row, np.arange(1, n)))
            yield pa.record_batch([batch.column(1), pa.array([x.tolist() for x in out], pa.list_(pa.int32()))], names=["toxic", "k"])

    examples = sample.mapInArrow(select, "toxic boolean, k array<int>").toArrow()
    x = [np.array(k, dtype=np.int64) for k in examples["k"].to_pylist()]
    weights, bias = train(x, examples["toxic"].to_numpy(zero_copy_only=False).astype(bool), prior, len(places))
    return Model(chosen, weights, bias)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty(0)]
            for _, _, raw, at in T.slices(batch, "text"):
                out.append(shared.value.scores(raw, at))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
