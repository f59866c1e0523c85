"""Vectorised byte-level text primitives shared by the operators.

Everything works on whole Arrow batches: the UTF-8 bytes of many texts in one
``uint8`` array plus row offsets.  No function loops over characters or words
in Python.  Memory is bounded by ``max_bytes`` or one text, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit words."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The same, with A-Z taken as a-z.
LOWER_VALUES = BYTE_VALUES[_LOWER]


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def reserve(self, n: int) -> None:
        if len(self.up) < n + 1:
            n = max(n, CHUNK_BYTES) + 1
            up, down = np.full(n, _BASE, _U), np.full(n, _BASE_INV, _U)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: int, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that each holds at most max_bytes of text, or one row."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        at, rows = 0, batch.num_rows
        while at < rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = min(rows, max(end, at + 1))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and row of each maximal run of word bytes; runs never cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    here = inside[1:-1]
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, whatever its place."""
    n = len(data)
    powers.reserve(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(values[data] * powers.up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(_U))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries (over row borders too; see gram_valid)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.zeros(m, _U)
    for j in range(n):
        out *= _U(_BASE)
        out += words[j : j + m]
    return mix64(out + _U(n))


def gram_valid(rows: np.ndarray, n: int) -> np.ndarray:
    """Whether n consecutive entries lie in one row."""
    m = len(rows) - n + 1
    return rows[:m] == rows[n - 1 :] if m > 0 else np.zeros(0, bool)


def sliding_min_last(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w entries, the place of its smallest one (the last of equals)."""
    m = len(values) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = values[:m].copy(), np.arange(m)
    for j in range(1, w):
        other = values[j : j + m]
        take = other <= best
        best[take] = other[take]
        at[take] = np.flatnonzero(take) + j
    return at


def member_mask(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table of distinct hashes has."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class HashSet:
    """A sorted table of hashes behind a one-bit filter on their upper bits."""

    def __init__(self, values: np.ndarray) -> None:
        self.table = np.unique(values)
        self.bits = min(24, max(10, int(len(self.table)).bit_length() + 5))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.table >> _U(64 - self.bits)] = True

    def positions(self, values: np.ndarray) -> np.ndarray:
        """Places in values of those that the set has."""
        maybe = np.flatnonzero(self.filter[values >> _U(64 - self.bits)])
        return maybe[member_mask(values[maybe], self.table)]
