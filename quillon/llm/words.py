"""Vectorised word hashing over the UTF-8 bytes of Arrow string columns.

A chunk of documents is one byte array. Each byte takes a fixed random 64-bit
number times B**position; prefix sums modulo 2**64 then give any word's hash in
two lookups. No per-word Python objects are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240501))
_PLAIN = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
MIX = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its rows' offsets in them; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Runs of at most `rows` rows and `most` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1), at + rows, n)
        yield at, end
        at = end


class Words:
    """Words of a chunk of rows: start and end byte (within the chunk), row, hash; `bounds[r]:bounds[r+1]` are row r's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        base, top = int(offsets[0]), int(offsets[-1])
        seg = data[base:top]
        rel = (offsets - base).astype(np.int64)
        inside = ~SPACE[seg]
        first = np.zeros(len(seg) + 1, bool)
        first[rel] = True
        before = np.empty(len(seg) + 1, bool)
        before[0], before[1:] = False, inside
        starts = np.flatnonzero(inside & (~before[:-1] | first[:-1]))
        after = np.empty(len(seg) + 1, bool)
        after[:-1], after[-1] = inside, False
        ends = np.flatnonzero(inside & (~after[1:] | first[1:])) + 1
        up, down = _power_tables(len(seg) + 1)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _PLAIN)[seg] * up[: len(seg)], out=sums[1:])
        self.hash = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        self.starts, self.ends, self.seg = starts, ends, seg
        self.bounds = np.searchsorted(starts, rel)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(rel) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of words at which k consecutive words of one row start, and those windows' hashes."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += self.hash[j : n - k + 1 + j] * MIX[j]
        return at, mix(total[at] + np.uint64(k))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct k-word shingles of each row, sorted by row and hash. A row of 1 to k-1 words has its whole sequence as one."""
    at, value = words.windows(k)
    row = words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words.counts[short] > j
            more[has] += words.hash[words.bounds[short[has]] + j] * MIX[j]
        row = np.concatenate([row, short])
        value = np.concatenate([value, mix(more + words.counts[short].astype(np.uint64))])
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    if len(row):
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[keep], value[keep]
    return row, value
