"""Periodic runs of words, found from Lyndon words.

A run is a longest stretch of consecutive words with smallest period q (words q apart are identical) that holds at
least ``least`` words and ``times`` periods. Every run repeats a Lyndon word of q words (its root), for one of an
order of the words and its reverse, and that root is the longest Lyndon word that starts at its place. So:

1. Phase one of Baier's suffix sorter groups the positions by their longest Lyndon word, from the highest group
   down: each member joins the context of the nearest position to its left that is in a lower group. The
   lengths of the contexts are the Lyndon array; it is taken under both orders.
2. Each position i with Lyndon length q whose next words equal those at i + q is a root; the longest common
   extension to both sides of (i, i + q) gives the run. A run is extended once, from its first root.

Only stretches whose windows of ``least // times`` words all occur again in the same text are grouped: each
window of a run has a copy one period before or after it, so no run is outside of them. They are put end to end
with a separator that is the least of both orders, which no Lyndon word can cross.

Words are compared by 64-bit hashes. Work and memory grow with the text; no row leaves its task.

Defined cases: null text has no words, and no runs; a null id is kept, and has no loop written into it; an empty
table gives an empty result; rows that share an id or a text are treated alike, each by itself; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.substring_dedup import joined_words
from mixclust.llm.words import Words, inside, mix, row_blocks, windows

LEAST = 24
TIMES = 3

_RUNS = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

#: For a row's id and its number of words: (start of the loop, its period), or None.
Loop = Callable[[int | None, int], tuple[int, int] | None]


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each position; of rank 0, the separators, 1. Ranks are 0 to some
    top without gaps."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[order], np.arange(int(rank.max(initial=0)) + 2))
    order = order.tolist()
    members = [order[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    group, active = rank.tolist(), np.diff(cuts).tolist()
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    above[-1] = -1
    left, right, length = list(range(-1, n - 1)), list(range(1, n + 1)), [1] * n
    at = len(members) - 1
    while at > 0:
        own = members[at]
        if active[at] < len(own):
            own = [i for i in own if group[i] == at]
        members[at] = None
        counts: dict[int, int] = {}
        for i in own:  # what is left to the left of each is in a lower group
            a, b = left[i], right[i]
            if b < n:
                left[b] = a
            if a >= 0:
                right[a] = b
                counts[a] = counts.get(a, 0) + 1
        if counts:
            size = length[own[0]]
            times = sorted(set(counts.values()), reverse=True)
            for c in times:
                moved: dict[int, list[int]] = {}
                for j, k in counts.items():
                    if k == c and group[j]:
                        length[j] += c * size
                        moved.setdefault(group[j], []).append(j)
                for old, some in moved.items():
                    if len(some) == active[old]:
                        continue  # all that are left of a group stay together
                    new, over = len(members), above[old]
                    members.append(some)
                    active.append(len(some))
                    active[old] -= len(some)
                    below.append(old)
                    above.append(over)
                    above[old] = new
                    if over >= 0:
                        below[over] = new
                    for j in some:
                        group[j] = new
        at = below[at]
    return np.array(length, np.int64)


def _recurring(ids: np.ndarray, words: Words, n: int, least: int) -> list[tuple[int, int]]:
    """Stretches [from, to) of at least ``least`` words whose windows of n words all occur twice in their row."""
    g, ok = windows(ids, n), inside(words, n)
    key = mix(g + words.row[: len(g)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(g) + 2, bool)
    twice[order[1:][same] + 1] = True
    twice[order[:-1][same] + 1] = True
    twice[1:-1] &= ok
    edge = np.flatnonzero(twice[1:] != twice[:-1])
    return [(a, b + n - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a + n - 1 >= least]


def _extent(ids: np.ndarray, lo: int, hi: int, i: int, p: int) -> tuple[int, int]:
    """The longest [from, to) within [lo, hi) around i and i + p that has period p."""
    end, step = i, 64
    while end + p < hi:
        m = min(step, hi - p - end)
        differ = ids[end : end + m] != ids[end + p : end + p + m]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = end + m, 2 * step
    begin, step = i, 64
    while begin > lo:
        m = min(step, begin - lo)
        differ = ids[begin - m : begin][::-1] != ids[begin - m + p : begin + p][::-1]
        if differ.any():
            begin -= int(differ.argmax())
            break
        begin, step = begin - m, 2 * step
    return begin, end + p


def runs_of(ids: np.ndarray, words: Words, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (first word, length, period) of all runs, words numbered through all rows; sorted."""
    n = max(1, least // times)
    zones = _recurring(ids, words, n, max(least, times))
    if not zones:
        return np.empty((0, 3), np.int64)
    lo, hi = np.array(zones).T
    size = hi - lo + 1  # with the separator
    begin = np.cumsum(size) - size
    zone = np.repeat(np.arange(len(zones)), size)
    place = np.arange(int(size.sum())) - begin[zone] + lo[zone]
    word = place < hi[zone]
    rank = np.zeros(len(place), np.int64)
    rank[word] = np.unique(ids[place[word]], return_inverse=True)[1] + 1
    g = windows(ids, n)
    found = []
    for ordered in (rank, np.where(rank > 0, rank.max() + 1 - rank, 0)):
        p = lyndon_lengths(ordered)
        i = np.flatnonzero(word & (place + p + n <= hi[zone]))
        i = i[g[place[i]] == g[place[i] + p[i]]]
        found.append(np.stack([p[i], place[i], zone[i]], 1))
    roots = np.unique(np.concatenate(found), axis=0)
    # a place can be in the ends of two stretches: a run is in one of them
    roots = roots[np.lexsort((roots[:, 1], roots[:, 0], roots[:, 2]))]
    key = (roots[:, 2] * (int(roots[:, 0].max(initial=0)) + 1) + roots[:, 0]) if len(roots) else roots[:, 0]
    group_end = np.searchsorted(key, key, "right")
    out, k = [], 0
    where = roots[:, 1]
    while k < len(roots):
        p, i, z = (int(x) for x in roots[k])
        a, b = _extent(ids, int(lo[z]), int(hi[z]), i, p)
        if b - a >= max(least, times * p):
            out.append((a, b - a, p))
        k += int(np.searchsorted(where[k : group_end[k]], b - p, "right"))
        # where[k] = i < b - p, so k grows
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def _collapse(batches: Iterator[pa.RecordBatch], carry: list[str], loop: Loop | None, least: int, times: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for rows in row_blocks(batch, "text"):
            words = Words(rows["text"])
            size = np.diff(words.first)
            ids = words.hashes()
            if loop is not None:
                source = np.arange(len(words))
                for row, (doc, n) in enumerate(zip(rows["doc_id"].to_pylist(), size.tolist(), strict=True)):
                    if n and (found := loop(doc, n)):
                        a, p = found
                        source[words.first[row] + a : words.first[row + 1]] = words.first[row] + a + np.arange(n - a) % p
                ids, words.start, words.end = ids[source], words.start[source], words.end[source]
            runs = runs_of(ids, words, least, times)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
            keep = np.cumsum(edge)[: len(words)] == 0
            row = words.row[runs[:, 0]]
            offsets = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
            parts = [pa.array(runs[:, 0] - words.first[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "length", "period"])).cast(kind)
            collapsed = pa.array([x.decode() for x in joined_words(words, keep)], pa.string())
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in carry), pa.array(size, pa.int64()), listed, collapsed], names=[*carry, "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, loop: Loop | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed:
    the words, joined by one space, without those that a run holds after its first period. ``loop`` writes a loop
    into texts first: words from a start on become those of one period."""
    if times < 2 or least < 2 * times:
        raise ValueError("a run has two periods and six words at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda x: _collapse(x, ["doc_id"], loop, least, times), f"doc_id long, {_RUNS}")


def tail_loop(doc: int | None, n: int) -> tuple[int, int] | None:
    """The loop of one id in ten, by the crc32 of its decimal text."""
    if doc is None:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def summary(collapsed: DataFrame) -> DataFrame:
    """Of the rows of collapse_runs(): doc_id, n_runs, the run of greatest length / period (ties: smallest start,
    then period) and digests of the runs and of the collapsed text."""
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("start", "length", "period")])
    better = lambda a, r: (a["period"] == 0) | (r["length"].cast("decimal(38,0)") * a["period"] > a["length"].cast("decimal(38,0)") * r["period"])
    best = F.aggregate("runs", none, lambda a, r: F.when(better(a, r), r).otherwise(a))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    out = collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("CAST(best.length * 1000 div best.period AS BIGINT)")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
