"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter of its letter n-grams. The filters are bit-sliced: all use the same
places, and each place holds one mask with a bit for each language, so looking up an n-gram is one AND
of ``HASHES`` masks and gives all languages that contain it. Over the n-grams of a text the bits of
each language are counted. A filter whose share ``fill`` of places is set answers yes by mistake with
the probability f = fill ** HASHES, so of n lookups with c hits (c - n * f) / (1 - f) are expected to be
true; the language with the most true ones is predicted, and the score is its share of the true ones
of all languages.

Learning reads every whole text whose language is known and that is not held out. An n-gram belongs
to a language if it makes up ``LEAST_SHARE`` of the language's n-grams or more, and not less than
``1 / RATIO`` of its largest share in any language: rare strangers in a large corpus do not
fill the filters. A language has at most 1 / LEAST_SHARE such n-grams whatever the size of the input, so
the filters have a fixed number of places (``2 ** BITS`` masks of 8 bytes for each 64 languages),
which bounds what is collected and broadcast. n-gram counts are combined per task before they are
shuffled by n-gram, so no language or frequent n-gram lands in one task.

n-grams: windows of ``GRAMS`` characters over the lower-cased words of letters, with a mark for the word's
start and end; a text's words are all its maximal runs of Unicode letters.

Null texts and texts without a letter give ``und`` and score 0. Texts without a known n-gram, and ties,
go to the language with more training rows, then to the smaller code point. Without a learned
language every text is ``und``. Null languages are not learned from, nor are rows with a null id; such rows
are predicted as not held out. Repeated rows count each. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.llm import text as T
from relloom.session import materialise

GRAMS = (1, 2, 3, 4)
LEAST_SHARE = 1e-5
RATIO = 4
BITS = 20
HASHES = 3
UNKNOWN = "und"
#: Characters of one pass over a batch.
SLICE_CHARS = 1 << 18

_letters: list[np.ndarray] = []
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter; built once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all n-grams of some texts."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
    row = np.repeat(np.arange(len(low), dtype=np.int32), size)
    row = np.concatenate((np.zeros(1, np.int32), row))  # the first mark belongs to the first text
    letter = letter_table()[code]
    # One mark stands between two words; words never cross texts, as a line feed does.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    code, row, letter = np.where(letter, code, 0)[keep].astype(np.uint64), row[keep], letter[keep]
    hashes, rows = [], []
    for n in GRAMS:
        if len(code) < n:
            break
        count = len(code) - n + 1
        h = np.full(count, np.uint64(n), dtype=np.uint64)
        whole = letter[:count].copy() if n == 1 else np.ones(count, dtype=bool)
        for k in range(n):
            h = h * _STEP + code[k : k + count] + np.uint64(1)
            if 0 < k < n - 1:
                whole &= letter[k : k + count]
        if n == 2:
            whole &= letter[:count] | letter[1:]
        hashes.append(T.mix(h[whole]))
        rows.append(row[n - 1 :][whole])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    return np.concatenate(hashes), np.concatenate(rows)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about SLICE_CHARS characters; null texts are empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= SLICE_CHARS:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


@dataclass
class Filters:
    """``masks`` (words, places) of uint64; bit l % 64 of word l // 64 belongs to ``languages[l]``."""

    languages: list[str]
    masks: np.ndarray
    mistaken: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.languages)
        fill = np.array([np.mean((self.masks[l // 64] >> np.uint64(l % 64)) & np.uint64(1)) for l in range(n)])
        self.mistaken = np.minimum(fill**HASHES, 1 - 1e-9)

    def hits(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """(rows, languages): n-grams of each row found in each language's filter."""
        out = np.zeros((rows, len(self.languages)))
        most = np.uint64((1 << BITS) - 1)
        for w, masks in enumerate(self.masks):
            found = masks[(h & most).astype(np.int64)]
            for j in range(1, HASHES):
                found &= masks[((h >> np.uint64(BITS * j)) & most).astype(np.int64)]
            for l in range(w * 64, min(w * 64 + 64, len(self.languages))):
                out[:, l] = np.bincount(row, (found >> np.uint64(l % 64)) & np.uint64(1), rows)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], [np.empty(0)]
        for _, run in pieces(texts):
            h, row = grams(run)
            n = np.bincount(row, minlength=len(run))
            true = np.maximum(0, (self.hits(h, row, len(run)) - n[:, None] * self.mistaken) / (1 - self.mistaken))
            # Languages are ordered by training rows, and the first of equal ones is taken.
            best, total = true.argmax(axis=1), true.sum(axis=1)
            score = np.where(total > 0, true.max(axis=1) / np.where(total > 0, total, 1), 0.0)
            known = n > 0
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, score, 0.0))
        return names, np.concatenate(scores)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters | None:
    """Filters from all rows that may be learned from; None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counted:
        return None
    languages = [r.lang for r in counted]
    number = {name: l for l, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for first, run in pieces(batch.column(1).to_pylist()):
                h, row = grams(run)
                lang = of[first + row]
                for l in np.unique(lang):
                    gram, n = np.unique(h[lang == l], return_counts=True)
                    yield pa.record_batch(
                        [pa.array(np.full(len(gram), l)), pa.array(gram.view(np.int64)), pa.array(n)], names=["l", "h", "n"]
                    )

    counts = rows.mapInArrow(count, "l bigint, h bigint, n bigint").groupBy("h", "l").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    totals = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    share = F.col("n") / F.element_at(F.lit([float(totals.get(l, 1)) for l in range(len(languages))]), F.col("l").cast("int") + 1)
    shares = counts.select("h", "l", share.alias("p")).where(F.col("p") >= LEAST_SHARE)
    by_gram = shares.groupBy("h").agg(F.max("p").alias("top"), F.collect_list(F.struct("l", "p")).alias("in"))
    word = lambda e: F.floor(e["l"] / 64)
    members = by_gram.select("h", F.explode(F.filter("in", lambda e: e["p"] * RATIO >= F.col("top"))).alias("e"))
    members = members.groupBy("h", word(F.col("e")).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(e.l % 64))")).alias("mask")
    )
    most = (1 << BITS) - 1
    places = F.array(*[F.shiftrightunsigned("h", BITS * j).bitwiseAND(F.lit(most)) for j in range(HASHES)])
    slices = members.select("w", "mask", F.explode(places).alias("place")).groupBy("w", "place").agg(F.bit_or("mask").alias("mask"))
    got = slices.toArrow()
    masks = np.zeros(((len(languages) + 63) // 64, 1 << BITS), dtype=np.uint64)
    w, place, mask = (got[c].to_numpy().astype(np.int64) for c in ("w", "place", "mask"))
    masks[w, place] = mask.view(np.uint64)
    return Filters(languages, masks)


def identified(docs: DataFrame, filters: Filters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names, scores = shared.value.predict(batch.column(1).to_pylist()) if shared.value else ([UNKNOWN] * n, np.zeros(n))
            yield pa.record_batch(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double").select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def language(docs: DataFrame) -> DataFrame:
    return identified(docs, learned(docs))
