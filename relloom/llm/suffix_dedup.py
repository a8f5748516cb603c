"""Exact substring removal by blockwise suffix sorting with cover-sample ranks.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, in the same document
or another. All suffixes of the corpus need not be sorted for that:

1. Each start p of such a string has an anchor: the smallest, leftmost one of the hashes of the
   ``GRAM``-byte runs inside [p, p + LENGTH). It depends on the string's bytes alone, so equal
   strings have equal anchors at equal offsets. Starts whose anchor occurs once are unique.
2. The anchors that occur again are the suffix buckets. Where all occurrences of an anchor agree in
   all bytes of the starts they own, by a 64-bit hash, the bucket is settled, and so are occurrences
   that agree with another one. Of the other buckets, one occurrence of each kind goes on: the
   documents are read again for those bytes, some 280 of each.
3. Buckets are sorted one block of them at a time (``BLOCK`` bytes, or one bucket). The occurrences
   are laid out with their anchors at multiples of ``COVER``; ranks of the cover sample, one position
   in COVER, are computed first, by doubling, to a depth of ``DEPTH`` bytes. A suffix is ordered by
   its bucket and offset, its first bytes up to a sample position, that position's rank, and the last bytes,
   which the rank does not reach; long ties never have to be read. Neighbours in that order that agree
   in all of these are equal over LENGTH bytes. As the anchors align all suffixes that can be equal,
   the cover needs one residue only, where a general difference cover has about sqrt(COVER).
4. A bucket with more than ``HOT`` kinds of occurrences is not sorted in one task: its starts are counted by
   digests of their strings, with partial sums before the shuffle.

Texts are UTF-8 bytes; null and empty ones have none. Repeated rows are copies of each other, so
both lose what is long enough. A row's key is its id with a 64-bit hash of its text, so rows with a null
id, or with different texts under one id, are judged and compared like any other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.llm import text as T
from relloom.session import materialise

LENGTH = 200
GRAM = 40
COVER = 32
DEPTH = 160
BLOCK = 2 << 20
HOT = 20_000

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_up = _down = np.empty(0, np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each place (len - GRAM + 1 of them)."""
    global _up, _down
    n = len(raw)
    if n < GRAM:
        return np.empty(0, np.uint64)
    if len(_up) < n:
        _up, _down = _powers(_BASE, n), _powers(_BACK, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _up[:n], out=sums[1:])
    return T.mix((sums[GRAM:] - sums[:-GRAM]) * _down[: n - GRAM + 1])


def owners(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor, its hash, hash of all bytes) of all runs of starts with
    one anchor. Places count from the slice's first byte.
    """
    grams = gram_hashes(raw)
    width = LENGTH - GRAM + 1
    none = np.empty(0, np.int64)
    if len(grams) < width:
        return none, none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(at) - (LENGTH - 1), 0))
    ok = np.arange(len(row)) - np.searchsorted(row, np.arange(len(at) - 1))[row] + at[:-1][row]
    anchor = anchor[ok]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))) if len(ok) else none
    last = np.append(new[1:], len(ok)) - 1
    lo, hi, place = ok[new], ok[last], anchor[new]
    # Six or more gram hashes, GRAM apart and one at the end, cover all bytes of a run.
    whole = T.mix((hi - lo).astype(np.uint64) << np.uint64(32) | (place - lo).astype(np.uint64))
    for step in range(0, LENGTH + width - GRAM, GRAM):
        whole = T.mix(whole ^ grams[np.minimum(lo + step, hi + LENGTH - GRAM)])
    whole = T.mix(whole ^ grams[hi + LENGTH - GRAM])
    return row[new], lo, hi, place, grams[place], whole


def _anchors(docs: DataFrame) -> DataFrame:
    """(id, anchor, start, more, whole) of all runs: starts start to start + more; ``whole`` is a hash
    of all bytes of those starts and of the anchor's place among them."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, raw, at in T.slices(batch, "text"):
                row, lo, hi, anchor, h, whole = owners(raw, at)
                yield pa.record_batch(
                    [batch.column(0).slice(first, rows).take(pa.array(row)), pa.array(h.view(np.int64)),
                     pa.array((lo - at[row]).astype(np.int32)), pa.array((hi - lo).astype(np.int16)), pa.array(whole.view(np.int64))],
                    names=["id", "anchor", "start", "more", "whole"],
                )

    return docs.mapInArrow(run, f"id {kind}, anchor bigint, start int, more smallint, whole bigint")


def _occurrences(held: DataFrame) -> DataFrame:
    """(anchor, id, start, offset, bytes) of the wanted runs of each document."""
    kind = held.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            for first, rows, raw, at in T.slices(batch, "text"):
                row, lo, hi, anchor, h, _ = owners(raw, at)
                sets = [wanted[first + r].values.to_numpy() for r in range(rows)]
                places = np.concatenate([s.astype(np.int64) + at[r] for r, s in enumerate(sets)])
                hit = np.flatnonzero(np.isin(lo, places))
                cut = [raw[a : b + LENGTH].tobytes() for a, b in zip(lo[hit], hi[hit], strict=True)]
                row, lo, anchor = row[hit], lo[hit], anchor[hit]
                yield pa.record_batch(
                    [pa.array(h[hit].view(np.int64)), batch.column(0).slice(first, rows).take(pa.array(row)),
                     pa.array((lo - at[row]).astype(np.int64)), pa.array((anchor - lo).astype(np.int32)), pa.array(cut, pa.binary())],
                    names=["anchor", "id", "start", "offset", "bytes"],
                )

    return held.mapInArrow(run, f"anchor bigint, id {kind}, start bigint, offset int, bytes binary")


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ranks(a << np.uint64(32) | b)


def repeated_starts(bucket: np.ndarray, offset: np.ndarray, cut: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence, start) of the starts whose LENGTH bytes another start of the block has too."""
    size = np.array([len(x) for x in cut], dtype=np.int64)
    room = -(-(size + COVER) // COVER) * COVER
    shift = (-offset.astype(np.int64)) % COVER
    base = np.cumsum(room) - room + shift
    text = np.zeros(int(room.sum()) + COVER + DEPTH, dtype=np.uint8)
    text = text[: len(text) // COVER * COVER]
    joined = np.frombuffer(b"".join(cut), dtype=np.uint8)
    text[np.arange(len(joined)) + np.repeat(base - (np.cumsum(size) - size), size)] = joined
    # Ranks of the cover sample, from 8 bytes on by doubling.
    eight = _ranks(text.view(">u8").astype(np.uint64)).reshape(-1, COVER // 8)
    rank = _pair(_pair(eight[:, 0], eight[:, 1]), _pair(eight[:, 2], eight[:, 3]))
    two = _pair(rank[:-1], rank[1:])
    four = _pair(two[:-2], two[2:])
    five = _pair(four[:-1], rank[4 : 4 + len(four) - 1])
    n = size - LENGTH + 1
    of = np.repeat(np.arange(len(cut)), n)
    start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    place = base[of] + start
    order_in = (offset[of] - start).astype(np.uint64)
    first = np.minimum(-(-place // COVER), len(five) - 1)
    key = (bucket[of].astype(np.uint64) << np.uint64(40)) | (order_in << np.uint64(32)) | five[first]
    # Starts that are alone with their bucket, offset and rank are not repeated; the others are put in suffix order,
    # by the last column first: bucket and offset, first bytes, rank, last bytes.
    order = np.argsort(key, kind="stable")
    twice = key[order[1:]] == key[order[:-1]]
    order = order[np.concatenate(([False], twice)) | np.concatenate((twice, [False]))]
    words = np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text.data, strides=(1,))
    begin, end = range(0, COVER, 8), range(DEPTH, LENGTH, 8)
    low = np.uint64(0xFFFFFFFF)
    for column in (*reversed(end), None, *reversed(begin), -1):
        values = key[order]
        if column is None:
            values &= low
        elif column < 0:
            values >>= np.uint64(32)
        else:
            values = words[place[order] + column].astype(np.uint64)
        order = order[np.argsort(values, kind="stable")]
    a, b = order[:-1], order[1:]
    some = np.flatnonzero(key[a] == key[b])
    for e in (*begin, *end):
        some = some[words[place[a[some]] + e] == words[place[b[some]] + e]]
    found = np.zeros(len(of), dtype=bool)
    found[a[some]] = True
    found[b[some]] = True
    return of[found], start[found]


def _sorted_buckets(occurrences: DataFrame) -> DataFrame:
    """(id, lo, hi): runs of repeated starts, from rows placed and sorted by anchor."""
    kind = occurrences.schema["id"].dataType.simpleString()

    def flush(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts).combine_chunks()
        anchor = table["anchor"].to_numpy()
        bucket = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
        cut = table["bytes"].to_pylist()
        of, start = repeated_starts(bucket, table["offset"].to_numpy(), cut)
        if not len(of):
            return
        new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1))))
        last = np.append(new[1:], len(of)) - 1
        ids = table["id"].take(pa.array(of[new])).combine_chunks()
        begin = table["start"].to_numpy()[of[new]]
        yield pa.record_batch([ids, pa.array(begin + start[new]), pa.array(begin + start[last])], names=["id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        size = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            parts.append(table)
            size += batch.column(4).nbytes
            while size >= BLOCK:
                whole = pa.concat_tables(parts).combine_chunks()
                anchor = whole["anchor"].to_numpy()
                heads = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
                if not len(heads):
                    break  # one bucket so far
                upto = heads[min(np.searchsorted(heads, int(len(anchor) * BLOCK / size)), len(heads) - 1)]
                yield from flush([whole.slice(0, upto)])
                rest = whole.slice(upto)
                parts, size = [rest], int(size * len(rest) / len(anchor))
        if parts:
            yield from flush(parts)

    placed = occurrences.repartition(_tasks(occurrences), "anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(run, f"id {kind}, lo bigint, hi bigint")


def _counted_starts(occurrences: DataFrame) -> DataFrame:
    """The same for hot buckets, by counting digests of the starts' strings."""
    kind = occurrences.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, digests = [], [], []
            for k in range(batch.num_rows):
                cut, begin = batch.column(4)[k].as_py(), batch.column(2)[k].as_py()
                for s in range(len(cut) - LENGTH + 1):
                    ids.append(k)
                    starts.append(begin + s)
                    digests.append(hashlib.blake2b(cut[s : s + LENGTH], digest_size=16).digest())
            yield pa.record_batch(
                [batch.column(1).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(digests, pa.binary())],
                names=["id", "start", "digest"],
            )

    starts = materialise(occurrences.mapInArrow(run, f"id {kind}, start bigint, digest binary"))
    again = starts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return starts.join(again, "digest").select("id", F.col("start").alias("lo"), F.col("start").alias("hi"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, text, runs): every document with its runs (lo, hi) of repeated starts, unmerged."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    anchors = materialise(_anchors(rows))
    counted = anchors.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")
    ).where("n > 1")
    shared = materialise(
        anchors.join(counted, "anchor").select(
            "anchor", "whole", "id", "start", "more", (F.col("low") == F.col("high")).alias("same")
        )
    )
    mixed = shared.where("NOT same")
    wholes = materialise(
        mixed.groupBy("anchor", "whole").agg(F.count("*").alias("m"), F.min(F.struct("id", "start")).alias("one"))
    )
    again = wholes.where("m > 1").select("anchor", "whole")
    settled = shared.where("same").unionByName(mixed.join(again, ["anchor", "whole"], "left_semi").select(*shared.columns))
    # One occurrence of each kind is compared; what it finds is news only if it is the only one.
    sizes = wholes.groupBy("anchor").agg((F.count("*") > hot).alias("hot"))
    compared = materialise(wholes.join(sizes, "anchor").select("one.id", "one.start", "hot"))
    # One placing of the texts by key serves the reading of the occurrences and the cutting.
    placed = rows.repartition(_tasks(rows), "id")
    start = F.col("start").cast("long")
    runs = settled.select("id", start.alias("lo"), (start + F.col("more")).alias("hi"))
    for is_hot in (False, True):
        some = compared.where(F.col("hot") == is_hot)
        if is_hot and not some.head(1):
            continue
        wanted = some.groupBy("id").agg(F.collect_set("start").alias("wanted"))
        found = _occurrences(placed.join(wanted, "id").select("id", "text", "wanted"))
        runs = runs.unionByName(_counted_starts(found) if is_hot else _sorted_buckets(found))
    gathered = runs.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return placed.join(gathered, "id", "left").select("id.id", "text", "runs")


def spans(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the strings that start in the runs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + LENGTH))
        else:
            out.append((lo, hi + LENGTH))
    return out


def deduplicated(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) from ``removal``: spans are byte ranges."""
    kind = found.schema["id"].dataType.simpleString()
    pair = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer() if text.is_valid else b""
                raw = memoryview(raw)
                cuts = spans(runs.as_py())
                digest, done = hashlib.sha256(), 0
                for a, b in cuts:
                    digest.update(raw[done:a])
                    done = b
                digest.update(raw[done:])
                row = (len(raw), sum(b - a for a, b in cuts), len(cuts), digest.hexdigest(), [{"lo": a, "hi": b} for a, b in cuts])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pair)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    return found.select("id", "text", "runs").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string,"
        " removed array<struct<lo:bigint,hi:bigint>>",
    )
