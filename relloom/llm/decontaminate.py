"""Benchmark decontamination with an FM-index over the words of each shard of documents.

A shard is a run of whole documents inside one task, ``SHARD_WORDS`` words at a time, so the index
is built where the texts are read: nothing of the corpus is shuffled and no key can be hot. Words
that occur in no benchmark item cannot be part of a match; each run of them is one sentinel of the
shard's text, and a suffix ends at its first sentinel. The index holds the Burrows-Wheeler
transform of that text as a wavelet matrix and the positions of every ``SAMPLE``-th suffix.
All windows are searched backwards at once; rows are located by walking to a sampled position.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words. Every shard is searched for all blocks,
one after the other, in its original text, and their hits are united before spans are made: the result
does not depend on where one block ends and the next begins. A task holds one block at a time.

Rules: text with A-Z in lower case; words are runs of ``[0-9a-z]`` and non-ASCII characters; a
window is ``WINDOW`` consecutive words of an item, or all words of a shorter item; every word inside
an occurrence of a window is hit. Null or empty texts have no words; items without words have no
window; items of equal text count each; rows with the same id are judged each on its own. Other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.llm import text as T

WINDOW = 10
SHARD_WORDS = 1_000_000
SAMPLE = 16
BLOCK_WORDS = 2_000_000


class Wavelet:
    """Rank over a sequence of small integers, for arrays of queries."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift) & 1 == 1
            words = np.packbits(bit, bitorder="little")
            words = np.concatenate((words, np.zeros(-len(words) % 8 + 8, np.uint8))).view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            zeros = len(values) - int(bit.sum())
            self.levels.append((shift, words, before, zeros))
            values = np.concatenate((values[~bit], values[bit]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        start = np.zeros_like(i)
        for shift, words, before, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = self._ones(words, before, start), self._ones(words, before, i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for shift, words, before, zeros in self.levels:
            block = i >> 6
            one = (words[block] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            a = self._ones(words, before, i)
            symbol |= one.astype(i.dtype) << shift
            i = np.where(one, zeros + a, i - a)
        return symbol


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes, each read up to its first 0; equal ones stand in text order."""
    n, depth = len(symbols), max(1, 63 // bits)
    key = np.zeros(n, dtype=np.int64)
    live = np.ones(n, dtype=bool)
    padded = np.concatenate((symbols, np.zeros(depth, dtype=symbols.dtype)))
    for k in range(depth):
        here = padded[k : k + n]
        live &= here > 0
        key = (key << bits) | np.where(live, here, 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    # Suffixes that end within the key are told apart by their place already.
    open_ = live[order]
    rank[order] = np.where(open_, group, np.arange(n))
    while True:
        size = np.bincount(group[open_], minlength=n) if open_.any() else np.zeros(1, np.int64)
        tied = np.flatnonzero(open_ & (size[np.minimum(group, len(size) - 1)] > 1))
        if not len(tied):
            return order
        at = order[tied]
        following = rank[np.minimum(at + depth, n)]
        place = np.lexsort((following, group[tied]))
        order[tied] = at[place]
        g, f = group[tied], following[place]
        split = np.concatenate(([True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])))
        start = np.maximum.accumulate(np.where(split, tied, 0))
        group[tied] = start
        rank[order[tied]] = start
        open_ = np.zeros(n, dtype=bool)
        open_[tied] = True
        depth *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, top: int):
        """``symbols`` ends with 0; symbols are 0 to ``top``."""
        bits = max(1, int(top).bit_length())
        order = suffix_array(symbols, bits)
        counts = np.bincount(symbols, minlength=top + 2)
        self.first = np.concatenate(([0], np.cumsum(counts)))[: top + 2]
        self.n = len(symbols)
        self.bwt = Wavelet(symbols[order - 1], bits)
        # Sampled: every SAMPLE-th position, and those behind a sentinel, where a walk must end.
        sampled = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.marks = Wavelet(sampled.astype(np.int64), 1)
        self.places = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each pattern (rows of a 0-padded table)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1] if len(patterns) else 0):
            go = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(go):
                break
            symbol = patterns[go, lengths[go] - 1 - step]
            lo[go] = self.first[symbol] + self.bwt.rank(symbol, lo[go])
            hi[go] = self.first[symbol] + self.bwt.rank(symbol, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows whose suffixes do not start with 0."""
        out, left, steps = np.empty_like(rows), np.arange(len(rows)), np.zeros_like(rows)
        now = rows.copy()
        while len(left):
            hit = self.marks.access(now) == 1
            k = self.marks.rank(np.ones_like(now[hit]), now[hit])
            out[left[hit]] = self.places[k] + steps[hit]
            left, now, steps = left[~hit], now[~hit], steps[~hit]
            symbol = self.bwt.access(now)
            now, steps = self.first[symbol] + self.bwt.rank(symbol, now), steps + 1
        return out


class Windows:
    """The distinct windows of a block of items as symbols, and the items of each."""

    def __init__(self, ids: list, texts: list[str | None]):
        batch = pa.record_batch([pa.array(texts, pa.string())], names=["t"])
        hashes = []
        for _, rows, raw, at in T.slices(batch, "t"):
            _, _, first, h = T.lower_words(raw, at, T.ALNUM)
            hashes += [h[first[r] : first[r + 1]] for r in range(rows)]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        found: dict[bytes, set] = {}
        for item, h in zip(ids, hashes, strict=True):
            symbols = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int64)
            size = min(WINDOW, len(symbols))
            for s in range(len(symbols) - size + 1 if size else 0):
                found.setdefault(symbols[s : s + size].tobytes(), set()).add(item)
        self.items = [sorted(x, key=str) for x in found.values()]
        self.lengths = np.array([len(x) // 8 for x in found], dtype=np.int64)
        self.patterns = np.zeros((len(found), WINDOW), dtype=np.int64)
        for k, x in enumerate(found):
            self.patterns[k, : self.lengths[k]] = np.frombuffer(x, dtype=np.int64)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), dtype=np.int64)
        k = np.searchsorted(self.vocabulary, h)
        k[k == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[k] == h, k + 1, 0)


def _occurrences(windows: Windows, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word index, window) of every occurrence in a shard; ``first`` has each row's first word."""
    none = np.empty(0, np.int64)
    if not len(symbols) or not len(windows.patterns):
        return none, none
    known = symbols > 0
    row_start = np.zeros(len(symbols), dtype=bool)
    row_start[first[:-1][first[:-1] < len(symbols)]] = True
    # One sentinel for each run of unknown words, one between documents, one at the end.
    keep = known | np.concatenate(([True], known[:-1]))
    breaks = row_start & known
    width = keep.astype(np.int64) + breaks
    place = np.cumsum(width) - 1
    short = np.zeros(int(width.sum()) + 1, dtype=np.int64)
    word = np.zeros(len(short), dtype=np.int64)
    short[place[known]] = symbols[known]
    word[place[known]] = np.flatnonzero(known)
    index = FMIndex(short, len(windows.vocabulary))
    lo, hi = index.search(windows.patterns, windows.lengths)
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
    return word[index.locate(rows)], which


class Blocks:
    """Broadcast blocks of the benchmark. Of several, one at a time is held, here and in a task."""

    def __init__(self, spark: SparkSession, blocks: Iterable[Windows]):
        self.shared: list[Broadcast] = []
        for windows in blocks:
            self.shared.append(spark.sparkContext.broadcast(windows))
            self._free(self.shared[-1])

    @staticmethod
    def _free(block: Broadcast) -> None:
        # unpersist() drops the copies of the executors; this one is the Python object, read again on demand.
        vars(block).pop("_value", None)

    def __iter__(self) -> Iterator[Windows]:
        for block in self.shared:
            yield block.value
            if len(self.shared) > 1:
                self._free(block)


def _shard(blocks: Iterable[Windows], ids: list, parts: list) -> Iterator[tuple]:
    """Rows of the result for the documents of one shard."""
    hashes = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.uint64)
    counts = np.array([len(p[2]) for p in parts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    per_doc: dict[int, set] = {}
    for windows in blocks:
        at, which = _occurrences(windows, windows.symbols(hashes), first)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + windows.lengths[which], -1)
        doc = np.searchsorted(first, at, side="right") - 1
        for d, w in np.unique(np.stack((doc, which), axis=1), axis=0) if len(doc) else ():
            per_doc.setdefault(int(d), set()).update(windows.items[w])
    hit = np.cumsum(edge[:-1]) > 0
    for d, (raw, (starts, ends), h) in enumerate(parts):
        spans = []
        if d in per_doc:
            mine = np.diff(np.concatenate(([0], hit[first[d] : first[d + 1]].astype(np.int8), [0])))
            head = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before a byte
            for a, b in zip(np.flatnonzero(mine == 1), np.flatnonzero(mine == -1), strict=True):
                spans.append((int(a), int(b), int(head[starts[a]]), int(head[ends[b - 1]])))
        yield ids[d], len(h), spans, sorted(map(str, per_doc.get(d, ())))


def _parts(raw: np.ndarray, at: np.ndarray, rows: int) -> list[tuple]:
    """Bytes, word bounds and word hashes of each row of a slice."""
    starts, ends, first, h = T.lower_words(raw, at, T.ALNUM)
    out = []
    for r in range(rows):
        own = slice(first[r], first[r + 1])
        out.append((raw[at[r] : at[r + 1]].copy(), (starts[own] - at[r], ends[own] - at[r]), h[own]))
    return out


def _pass(docs: DataFrame, blocks: Blocks, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {id_type}, n_words bigint, spans array<struct<w0:int,w1:int,c0:int,c1:int>>, items array<string>"
    )
    span = pa.list_(pa.struct([(x, pa.int32()) for x in ("w0", "w1", "c0", "c1")]))

    def batch_of(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        a, b, c, d = zip(*rows, strict=True)
        spans = [[dict(zip(("w0", "w1", "c0", "c1"), x, strict=True)) for x in s] for s in c]
        return pa.record_batch(
            [pa.array(a, id_kind), pa.array(b, pa.int64()), pa.array(spans, span), pa.array(d, pa.list_(pa.string()))],
            names=["id", "n_words", "spans", "items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field("id").type
            names = batch.column(0).to_pylist()
            for row, rows, raw, at in T.slices(batch, "text"):
                own = _parts(raw, at, rows)
                ids += names[row : row + rows]
                parts += own
                size += sum(len(p[2]) for p in own)
                if size >= SHARD_WORDS:
                    yield batch_of(list(_shard(blocks, ids, parts)), kind)
                    ids, parts, size = [], [], 0
        if ids:
            yield batch_of(list(_shard(blocks, ids, parts)), kind)

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Windows]:
    """Blocks of whole items, each of at most BLOCK_WORDS words or one item."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids: list = []
    texts: list = []
    size = 0
    for item in items.toLocalIterator():  # one partition at a time
        n = len((item.text or "").split())
        if ids and size + n > BLOCK_WORDS:
            yield Windows(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item.id)
        texts.append(item.text)
        size += n
    yield Windows(ids, texts)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, n_words, spans, items) for every document.

    ``spans``: maximal runs of hit words as word and code-point ranges, ends exclusive; ``items``:
    ids of the items with an occurring window, as sorted strings.
    """
    return _pass(docs, Blocks(docs.sparkSession, _blocks(benchmark, item_col, item_text)), id_col, text_col)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``contamination``."""
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.expr("aggregate(spans, 0L, (s, x) -> s + (x.w1 - x.w0))").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` with every hit span cut out of its text; all rows and columns stay, in their order.

    Rows without a hit are passed on unchanged, null texts too. A document that consists of nothing
    but hits keeps an empty text.
    """
    blocks = Blocks(docs.sparkSession, _blocks(benchmark, item_col, item_text))

    def flush(waiting: list[pa.RecordBatch], parts: list) -> Iterator[pa.RecordBatch]:
        found = _shard(blocks, range(len(parts)), parts)
        for batch in waiting:
            k = batch.schema.get_field_index(text_col)
            new: dict[int, str] = {}
            for r in range(batch.num_rows):
                spans = next(found)[2]
                if spans:
                    text, done, kept = batch.column(k)[r].as_py(), 0, []
                    for _, _, c0, c1 in spans:
                        kept.append(text[done:c0])
                        done = c1
                    new[r] = "".join([*kept, text[done:]])
            if new:
                texts = batch.column(k).to_pylist()
                for r, text in new.items():
                    texts[r] = text
                columns = list(batch.columns)
                columns[k] = pa.array(texts, batch.schema.field(k).type)
                batch = pa.record_batch(columns, schema=batch.schema)
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, parts, size = [], [], 0
        for batch in batches:
            for row, rows, raw, at in T.slices(batch, text_col):
                own = _parts(raw, at, rows)
                waiting.append(batch.slice(row, rows))
                parts += own
                size += sum(len(p[2]) for p in own)
                if size >= SHARD_WORDS:
                    yield from flush(waiting, parts)
                    waiting, parts, size = [], [], 0
        yield from flush(waiting, parts)

    return docs.mapInArrow(run, docs.schema)
