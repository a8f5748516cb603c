"""Words, hashes and shingles of Arrow string columns, with numpy over whole batches.

The functions here work on the UTF-8 bytes of a slice of documents at once, so a task's memory is
bounded by the slice (``SLICE_BYTES``, or one document if that is longer), not by its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Bytes of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_SPACE = byte_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
ALNUM = byte_table(bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80))
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows; null texts have no bytes."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end - row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a slice, and for each row the index of its first word.

    Words are maximal runs of the table's bytes that do not cross rows.
    """
    n = len(raw)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = table[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    if len(cuts):
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes, eight bytes at a time."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    left = np.minimum(length, np.uint64(8))
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
    h = mix((eight[starts] & keep) ^ (length * _STEP))
    more = np.flatnonzero(length > 8)
    done = 8
    while len(more):
        left = np.minimum(length[more] - np.uint64(done), np.uint64(8))
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        h[more] = mix(h[more] * _STEP + (eight[starts[more] + done] & keep))
        done += 8
        more = more[length[more] > done]
    return h


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words of one text; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * _M2 + h[k : k + n]
    return mix(out + np.uint64(size * int(_STEP) % 2**64))


def lower_words(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """starts, ends, first word of each row, and word hashes of the text with A-Z in lower case."""
    low = LOWER[raw]
    starts, ends, first = words(low, at, table)
    return starts, ends, first, word_hashes(low, starts, ends)
