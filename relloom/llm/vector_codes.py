"""Product codes of integer vectors, with exact nearest entries by slice-and-intersect bitmasks.

Every vector is cut into ``PARTS`` equal parts, and each part is replaced by the index of the nearest of
at most ``ENTRIES`` = 64 codebook entries of its position, so a set of entries is one uint64. For each
coordinate the entries are sorted, and the mask of the first i entries in that order is kept for every
i. A part x with radius r finds, by two binary searches a coordinate, the slice of entries whose
coordinate lies in [x - r, x + r] as the difference of two prefix masks; the slices of all coordinates
ANDed are the candidates. An entry at Euclidean distance d is among the candidates of every radius
r >= d, so once the best candidate lies within the radius it is the nearest of all entries, and all
entries at the same distance are candidates too: ties go to the lower index. Otherwise the radius
becomes the best candidate's distance rounded up, or doubles if there is none.

Components become floor(256 * x). The codebooks start as the parts of the 64 smallest ids and are
moved ``ROUNDS`` times to the componentwise floor of their members' mean; an entry without members
stays. Tasks sum their members' components per entry, Spark adds these sums up, and the driver gets one
row per entry and coordinate: its size depends on the codebooks alone.

Dropped are rows whose vector is null, empty or holds null or non-finite components; also those whose
length is not that of the smallest kept id's vector (which must be a multiple of ``PARTS``), and those
with an integer component beyond 2 ** 26, whose squared distances would not fit 64 bits. Null ids come
last in the order of ids, equal ids are ordered by their vectors; each such row has a code of its own.
Null labels are one label. With fewer than 64 rows there are fewer entries; an empty table gives no
rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.session import lookup, materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
LARGEST = 1 << 26


class Slices:
    """Sorted coordinates and prefix masks of one position's entries."""

    def __init__(self, book: np.ndarray):
        self.book = book
        size, width = book.shape
        order = np.argsort(book, axis=0, kind="stable")
        self.coordinate = np.take_along_axis(book, order, axis=0).T.copy()
        bits = np.uint64(1) << order.T.astype(np.uint64)
        self.prefix = np.zeros((width, size + 1), dtype=np.uint64)
        self.prefix[:, 1:] = np.bitwise_or.accumulate(bits, axis=1)
        # Half of the entries have another one this close in every coordinate.
        apart = np.abs(book[:, None, :] - book[None, :, :]).max(axis=2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.radius = int(max(1, np.median(apart.min(axis=1)))) if size > 1 else 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of each row of ``x`` in every coordinate."""
        found = np.full(len(x), ~np.uint64(0))
        for j, (sorted_, prefix) in enumerate(zip(self.coordinate, self.prefix, strict=True)):
            low = np.searchsorted(sorted_, x[:, j] - radius, side="left")
            high = np.searchsorted(sorted_, x[:, j] + radius, side="right")
            found &= prefix[high] ^ prefix[low]
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, for each row of ``x``."""
        index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        left = np.arange(len(x))
        radius = np.full(len(x), self.radius, dtype=np.int64)
        while len(left):
            masks = self.candidates(x[left], radius)
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            apart = ((x[left[row]] - self.book[entry]) ** 2).sum(axis=1)
            hit, first = np.unique(row, return_index=True)
            best = np.minimum.reduceat(apart, first) if len(first) else apart
            at = np.flatnonzero(apart == np.repeat(best, np.diff(np.append(first, len(row)))))
            at = at[np.unique(row[at], return_index=True)[1]]
            index[left[hit]], distance[left[hit]] = entry[at], best
            reach = np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64)
            radius_hit = radius[hit]
            radius *= 2
            radius[hit] = reach + 1
            sure = np.zeros(len(left), dtype=bool)
            sure[hit] = best <= radius_hit * radius_hit
            left, radius = left[~sure], radius[~sure]
        return index, distance


@dataclass
class Codebooks:
    """``entries`` (parts, entries, width); entry e of part p is ``entries[p, e]``."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) entry indices and squared distances."""
        parts, _, width = self.entries.shape
        index = np.empty((len(vectors), parts), dtype=np.int64)
        distance = np.empty_like(index)
        for p in range(parts):
            index[:, p], distance[:, p] = Slices(self.entries[p]).nearest(vectors[:, p * width : (p + 1) * width])
        return index, distance


def whole_numbers(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """Rows kept of a list column, and their integer vectors; all of ``length``, or of any usable one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    # Without null lists flatten() keeps all components; null lists have none.
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * flat)
        bad = ~(np.abs(scaled) <= LARGEST)
    ends = np.cumsum(sizes)
    wrong = np.append(0, np.cumsum(bad))
    fits = sizes == length if length else (sizes > 0) & (sizes % PARTS == 0)
    keep = np.flatnonzero(fits & (wrong[ends] == wrong[ends - sizes]))
    whole = np.where(bad, 0, scaled).astype(np.int64)
    if length:
        return keep, whole[(ends[keep] - length)[:, None] + np.arange(length)]
    return keep, [whole[ends[k] - sizes[k] : ends[k]] for k in keep]


def _smallest(rows: DataFrame) -> list[list[int]]:
    """The integer vectors of the ENTRIES smallest ids among those of the first one's length."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vectors = whole_numbers(batch.column(1))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(keep)), pa.array([v.tolist() for v in vectors], pa.list_(pa.int64()))],
                names=["vec_id", "v"],
            )

    found = rows.select("vec_id", "v").mapInArrow(clean, f"vec_id {kind}, v array<bigint>")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = [r.v for r in found.orderBy(*order).limit(ENTRIES).collect()]
    if first and any(len(v) != len(first[0]) for v in first):
        first = [r.v for r in found.where(F.size("v") == len(first[0])).orderBy(*order).limit(ENTRIES).collect()]
    return first


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries at the floor of their members' mean."""
    parts, size, width = books.entries.shape
    length = books.length

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * size, dtype=np.int64), np.zeros((parts * size, width), dtype=np.int64)
        for batch in batches:
            _, vectors = whole_numbers(batch.column(0), length)
            index, _ = books.assign(vectors)
            for p in range(parts):
                count += np.bincount(p * size + index[:, p], minlength=parts * size)
                np.add.at(total, p * size + index[:, p], vectors[:, p * width : (p + 1) * width])
        used = np.flatnonzero(count)
        cell = np.repeat(used, width + 1)
        place = np.tile(np.arange(-1, width), len(used))
        value = np.column_stack((count[used], total[used])).ravel()
        yield pa.record_batch([pa.array(cell), pa.array(place), pa.array(value)], names=["cell", "place", "value"])

    added = (
        rows.select("v").mapInArrow(sums, "cell bigint, place bigint, value bigint")
        .groupBy("cell", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    )
    cells: dict[int, dict[int, int]] = {}
    for r in added.collect():
        cells.setdefault(r.cell, {})[r.place] = int(r.value)
    entries = books.entries.copy()
    for cell, values in cells.items():
        entries[cell // size, cell % size] = [values[j] // values[-1] for j in range(width)]
    return Codebooks(entries)


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    return vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")
    )


def fit(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks from all rows; None if no row is kept."""
    rows = _rows(vectors, id_col, vector_col, label_col)
    first = _smallest(rows)
    if not first:
        return None
    books = Codebooks(np.array(first, dtype=np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def encoded(
    vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, label, code, error) for every kept row."""
    rows = _rows(vectors, id_col, vector_col, label_col)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, whole = whole_numbers(batch.column(1), books.length) if books else (np.empty(0, np.int64), None)
            index, distance = books.assign(whole) if books else (np.empty((0, PARTS), np.int64),) * 2
            codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
            take = pa.array(keep)
            yield pa.record_batch(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))],
                names=["vec_id", "label", "code", "error"],
            )

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compressed(vectors: DataFrame, **columns: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every kept row."""
    books = fit(vectors, **columns)
    coded = materialise(encoded(vectors, books, **columns))
    by_label = lookup(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"),
    )


def codes_sql() -> str:
    """The same codes by all distances, for vectors of 64 components."""
    width = 64 // PARTS
    apart = " + ".join(f"(x[{j}] - c[{j}]) * (x[{j}] - c[{j}])" for j in range(1, width + 1))
    mean = ", ".join(f"CAST(floor(sum(x[{j}]) / count(*)) AS BIGINT)" for j in range(1, width + 1))
    steps = [
        f"""b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  QUALIFY e < {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT vec_id, label, p, x, e, d FROM (SELECT vec_id, label, p, x, e, {apart} AS d FROM parts JOIN b{k} USING (p))
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""b{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM b{k} LEFT JOIN (SELECT p, e, [{mean}] AS m FROM a{k} GROUP BY p, e) USING (p, e))"""
            )
    return f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * {width} + 1:(p + 1) * {width}] AS x
  FROM whole, (SELECT unnest(range({PARTS})) AS p)),
{", ".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded
"""


CODES_SQL = codes_sql()
