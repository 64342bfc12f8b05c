"""Texts of an Arrow batch as one flat byte array, with words, lines and their hashes as numpy arrays.

All functions take `data` (uint8) and `offsets` (int64, one more than there are texts); text i is
`data[offsets[i]:offsets[i + 1]]` in UTF-8. A null text is an empty one. Work is cut into slices of whole texts, so that
the memory of a task does not depend on how many rows a batch has, only on the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_weights = np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the result."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(n: int) -> np.ndarray:
    """At least n pseudo-random odd 64-bit factors, the same in every process."""
    global _weights
    if len(_weights) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _weights = mix((np.arange(size, dtype=np.uint64) + np.uint64(1)) * _GOLDEN) | np.uint64(1)
    return _weights


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "")
    kind = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """(rows, data, offsets): the batches cut into runs of whole texts of about `limit` bytes."""
    for batch in batches:
        data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < len(offsets) - 1:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` bytes within each text: starts, stops, and per text the number of its first run."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of anything but space, tab, newline, vertical tab, form feed and carriage return."""
    return split(data, offsets, ~_SPACE[data])


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty pieces between newlines."""
    return split(data, offsets, data != 10)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each run data[start:stop]. Runs are in order and don't overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = stops - starts
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    there = within + np.repeat(starts, lengths)
    terms = (data[there].astype(np.uint64) + np.uint64(1)) * weights(int(lengths.max()))[within]
    return mix(np.add.reduceat(terms, ends - lengths))


def windows(hashed: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` runs that stay inside a text, and where (in runs) each begins.

    `first` holds the number of the first run of each text, and the number of all runs at its end.
    """
    count = len(hashed) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(count, np.uint64)
    for k, w in enumerate(weights(size)[:size]):
        total += hashed[k : k + count] * w
    inside = np.ones(len(hashed) + 1, bool)
    for k in range(1, size):
        inside[np.maximum(first[1:] - k, first[:-1])] = False
    where = np.flatnonzero(inside[:count])
    return mix(total[where] + np.uint64(size)), where


def owner(first: np.ndarray) -> np.ndarray:
    """The number of the text of each run."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of the mask are set in each text."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
