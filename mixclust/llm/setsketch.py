"""SetSketch registers of word-shingle sets, their bands, and the joint likelihood of two sketches.

Each element of a set emits a Poisson process of values, each marked with a register; a register keeps
the least value it sees, on an exponential scale of base BASE, truncated to a byte. Registers of a union are
the maxima of the registers, so sketches merge; equal registers are as likely as sets are alike.
"""

from __future__ import annotations

import numpy as np

from mixclust.llm.words import Words, inside, mix, windows

WORDS = 5
ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
BASE, RATE, LIMIT = 1.15, 0.002, 254
_LN = np.log(BASE)
_DEEP = 14.0  # a register stays empty with probability e^-14, and then counts as 0


def shingle_sets(words: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle ids of all rows, end to end and sorted within a row, and the rows' offsets. A row
    of fewer than n words has its whole sequence as one shingle, a row without words none."""
    ids = words.hashes()
    g, ok = windows(ids, n), inside(words, n)
    row, value = words.row[: len(g)][ok], g[ok]
    size = np.diff(words.first)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        lone = np.zeros(len(few), np.uint64)
        for k in range(n):
            at = words.first[few] + np.minimum(k, size[few] - 1)
            lone = mix(lone * np.uint64(0x100000001B3) + np.where(k < size[few], ids[at], np.uint64(k + 1)))
        row, value = np.concatenate([row, few]), np.concatenate([value, lone])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(size) + 1))


def sketches(value: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Registers (uint8) of each row's set of ids."""
    n = len(offs) - 1
    out = np.zeros(n * REGISTERS, np.uint8)
    size = np.diff(offs)
    row = np.repeat(np.arange(n), size)
    # values beyond this are larger than each register's least, but for a probability of e^-_DEEP
    top = (_DEEP + np.log(REGISTERS)) / (np.maximum(size, 1) * RATE)
    seed, x = value.copy(), np.zeros(len(value))
    while len(seed):
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (RATE * REGISTERS)
        live = x < top[row]
        seed, x, row = seed[live], x[live], row[live]
        register = (mix(seed ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(REGISTERS)).astype(np.int64)
        level = np.clip(np.floor(1 - np.log(x) / _LN) + 45, 0, LIMIT + 1).astype(np.uint8)
        np.maximum.at(out, row * REGISTERS + register, level)
    return out.reshape(n, REGISTERS)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of each pair of sketches, with the sets' sizes known, jointly
    from the registers that are greater in a, greater in b, and equal."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = size_a / (size_a + size_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LN

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return up * np.log(more + tiny) + down * np.log(less + tiny) + same * np.log(np.maximum(1 - more - less, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave in j
        one, two = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(one) < likelihood(two)
        low, high = np.where(better, one, low), np.where(better, high, two)
    return (low + high) / 2


def margin(threshold: float, ratio: float = 1.0, most: float = 1e-6) -> float:
    """How far (in hundredths) below ``threshold`` estimates of pairs at it can lie, but for a probability under
    ``most``; ``ratio``: of the pair's sizes. Registers count as independent."""
    up, down = (x.ravel() for x in np.meshgrid(np.arange(REGISTERS + 1), np.arange(REGISTERS + 1), indexing="ij"))
    up, down = up[up + down <= REGISTERS], down[up + down <= REGISTERS]
    place = np.arange(REGISTERS)[None]
    a, b = (place < up[:, None]).astype(np.uint8), ((place >= up[:, None]) & (place < (up + down)[:, None])).astype(np.uint8)
    estimate = similarity(a, b, np.full(len(up), ratio), np.ones(len(up)))
    u = ratio / (1 + ratio)
    more, less = (-np.log1p(-x * (BASE - 1) / BASE) / _LN for x in (u - (1 - u) * threshold, (1 - u) - u * threshold))
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, REGISTERS + 1)))])
    same = REGISTERS - up - down
    chance = np.exp(fact[REGISTERS] - fact[up] - fact[down] - fact[same] + up * np.log(max(more, 1e-300)) + down * np.log(max(less, 1e-300)) + same * np.log(1 - more - less))
    return next((m / 100 for m in range(1, 100) if chance[estimate < threshold - m / 100].sum() < most), threshold)
