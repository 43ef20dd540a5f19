"""Words of whole texts as flat numpy arrays, straight from Arrow's string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which on UTF-8 text equals
``[^\\x20\\x09-\\x0D]+``. Null texts count as empty. Words get 64-bit hashes; windows of n words
get hashes by doubling (a window of n from two overlapping windows of ceil(n/2)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LONGEST = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 257, dtype=np.uint64) * _C1)
    powers = mix(np.arange(1, _LONGEST + 1, dtype=np.uint64) * _C3) | np.uint64(1)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return seeds, powers, space, lower


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], wide, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    _, offs = flat(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a string column: byte ``start`` and ``end`` of each, ``first`` (n + 1 word offsets of the
    rows), and ``row`` of each word. ``lower``: A-Z count as a-z in hashes."""

    def __init__(self, col: pa.Array, lower: bool = False):
        self.seeds, self.powers, space, to_lower = _tables()
        self.data, self.offs = flat(col)
        self.lower = to_lower if lower else None
        n = len(self.data)
        inside = ~space[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        begins, ends = np.empty(n, bool), np.empty(n, bool)
        if n:
            begins[0], ends[-1] = inside[0], inside[-1]
            begins[1:] = inside[1:] & (~inside[:-1] | edge[1:n])
            ends[:-1] = inside[:-1] & (~inside[1:] | edge[1:n])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offs)
        self.row = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        size = self.end - self.start
        at = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        chars = self.data[inside + np.repeat(self.start, size)]
        if self.lower is not None:
            chars = self.lower[chars]
        if int(size.max()) > _LONGEST:  # the same values as the table, without one of that length
            spread = mix((inside.astype(np.uint64) + np.uint64(1)) * _C3) | np.uint64(1)
        else:
            spread = self.powers[inside]
        return mix(np.add.reduceat(self.seeds[chars] * spread, at) + size.astype(np.uint64) * _C1)


def join_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The id of a window from the ids of its two halves, in order."""
    return mix(a * _C1 + (b ^ (b >> np.uint64(29))) * _C2 + _C3)


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Ids of all windows of n consecutive words, as if the rows were one sequence; see inside()."""
    if n == 1:
        return ids
    if len(ids) < n:
        return np.empty(0, np.uint64)
    half = (n + 1) // 2
    h = windows(ids, half)
    return join_ids(h[: len(ids) - n + 1], h[n - half : n - half + len(ids) - n + 1])


def inside(words: Words, n: int) -> np.ndarray:
    """Whether the window of n words from each position stays within its row."""
    k = max(0, len(words) - n + 1)
    return np.arange(n, n + k) <= words.first[words.row[:k] + 1]


def sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each n consecutive values, by doubling."""
    pick, size = (np.minimum if least else np.maximum), 1
    if len(x) < n:
        return x[:0]
    while size * 2 <= n:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return x if size == n else pick(x[: len(x) - (n - size)], x[n - size :])
