"""Exact arg-min over many centroids by branch and bound, in blocks of points.

For a block of points and all k centroids the weighted numeric distances are one matrix. Every string distance is
bounded from below by the difference in length and by the characters that only one of the terms has (counted in
CLASSES classes). Each point evaluates its candidates in the order of these bounds and stops when the next bound is
above the best distance so far; an edit distance is computed once for each pair of distinct terms of a block that is
asked for, many pairs at a time (bit-parallel).

Sums run in the order of the features, as in the Column plan, and rounding is monotonic, so a bound is never above its
distance and both plans give the same numbers and the same winner: equal distances go to the later centroid, and a
distance that is NULL or NaN never wins. Used for the distances whose names are in NUMERIC and STRINGS.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CLASSES = 16
CELLS = 1 << 20
PAIRS = 1 << 16
NUMERIC = ("euclidean", "manhattan", "cosine")
STRINGS = ("levenshtein", "normalizedLevenshtein")


@dataclass(frozen=True)
class Part:
    """A feature with its weight. ``columns``: coordinates, or the one column of terms."""

    kind: str
    distance: str
    columns: tuple[str, ...]
    weight: float


def numeric_matrix(distance: str, a: list[np.ndarray], b: list[np.ndarray], rescale: float) -> np.ndarray:
    """Distances of all rows of a to all rows of b, given by coordinate."""
    def total(terms: Iterator[np.ndarray]) -> np.ndarray:
        out = next(terms)
        for t in terms:
            out = out + t
        return out

    pairs = [(x[:, None], y[None, :]) for x, y in zip(a, b, strict=True)]
    if distance == "euclidean":
        d = np.sqrt(total((x - y) * (x - y) for x, y in pairs))
    elif distance == "manhattan":
        d = total(np.abs(x - y) for x, y in pairs)
    else:
        den = np.sqrt(total(x * x for x, _ in pairs)) * np.sqrt(total(y * y for _, y in pairs))
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(den != 0, 1.0 - total(x * y for x, y in pairs) / den, np.nan)
    return d / rescale


class Terms:
    """Distinct strings as code points."""

    def __init__(self, values: list[str]):
        coded = [np.frombuffer(v.encode("utf-32-le"), np.uint32) for v in values]
        self.length = np.array([len(c) for c in coded], np.int64)
        self.chars = np.concatenate([np.empty(0, np.uint32), *coded])
        self.first = np.cumsum(self.length) - self.length
        row = np.repeat(np.arange(len(coded)), self.length)
        self.counts = np.bincount(row * CLASSES + self.chars % CLASSES, minlength=len(coded) * CLASSES).reshape(-1, CLASSES)


def least_edits(a: Terms, b: Terms) -> np.ndarray:
    """A lower bound of the edit distance of each pair: of the characters that only a, or only b, has, the more."""
    out = np.zeros((len(a.length), len(b.length)), np.int64)
    only_a = np.zeros_like(out)
    for c in range(CLASSES):
        d = a.counts[:, c][:, None] - b.counts[:, c][None, :]
        only_a += np.maximum(d, 0)
        out += np.maximum(-d, 0)
    return np.maximum(out, only_a)  # their difference is that of the lengths


def edits(a: Terms, b: Terms, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances (unit costs, code points) of the pairs a[i], b[j]."""
    out = np.empty(len(i), np.int64)
    short_b = b.length[j] <= 64
    short_a = ~short_b & (a.length[i] <= 64)
    for mine, (x, p, y, q) in ((short_b, (a, i, b, j)), (short_a, (b, j, a, i))):
        at = np.flatnonzero(mine)
        for k in range(0, len(at), PAIRS):
            some = at[k : k + PAIRS]
            out[some] = _bit_parallel(x, p[some], y, q[some])
    for k in np.flatnonzero(~short_a & ~short_b).tolist():
        out[k] = _by_rows(a.chars[a.first[i[k]] :][: a.length[i[k]]], b.chars[b.first[j[k]] :][: b.length[j[k]]])
    return out


def _bit_parallel(a: Terms, i: np.ndarray, b: Terms, j: np.ndarray) -> np.ndarray:
    """Columns of the edit matrix as two bit vectors of vertical differences; terms of b are at most 64 long."""
    used, j = np.unique(j, return_inverse=True)
    size = b.length[used]
    row = np.repeat(np.arange(len(used)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    chars = b.chars[np.repeat(b.first[used], size) + at]
    letters = np.unique(chars)
    masks = np.zeros((len(used), len(letters) + 1), np.uint64)  # the last: letters that no term of b has
    np.bitwise_or.at(masks, (row, np.searchsorted(letters, chars)), np.uint64(1) << at.astype(np.uint64))
    if len(letters):
        letter = np.searchsorted(letters, a.chars)
        letter = np.where((letter < len(letters)) & (letters[np.minimum(letter, len(letters) - 1)] == a.chars), letter, len(letters))
    else:
        letter = np.zeros(len(a.chars), np.int64)
    one = np.uint64(1)
    n, m = a.length[i], size[j]
    order = np.argsort(-n, kind="stable")
    n, m, first, j = n[order], m[order], a.first[i][order], j[order]
    top = np.where(m > 0, one << np.maximum(m - 1, 0).astype(np.uint64), np.uint64(0))
    plus, minus, score = np.full(len(n), ~np.uint64(0)), np.zeros(len(n), np.uint64), m.copy()
    for step in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -step, "left"))  # those longer than step
        p, q = plus[:live], minus[:live]
        eq = masks[j[:live], letter[first[:live] + step]]
        vertical = eq | q
        diagonal = (((eq & p) + p) ^ p) | eq
        up, down = q | ~(diagonal | p), p & diagonal
        score[:live] += ((up & top[:live]) != 0).astype(np.int64) - ((down & top[:live]) != 0)
        up = (up << one) | one
        plus[:live], minus[:live] = (down << one) | ~(vertical | up), up & vertical
    score = np.where(m == 0, n, score)
    out = np.empty(len(n), np.int64)
    out[order] = score
    return out


def _by_rows(x: np.ndarray, y: np.ndarray) -> int:
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for k, c in enumerate(x.tolist(), 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.concatenate([[k], new]) - steps) + steps
    return int(row[-1])


class Search:
    """The centroids (dicts with cluster_id, coordinates and terms), ready for blocks of points."""

    def __init__(self, centroids: Sequence[dict], parts: Sequence[Part], rescale: float):
        self.parts, self.rescale = list(parts), rescale
        ordered = sorted(centroids, key=lambda c: -int(c["cluster_id"]))  # an arg-min takes the first: the later id
        self.ids = np.array([int(c["cluster_id"]) for c in ordered])
        self.sides = []
        for p in self.parts:
            values = [[c.get(n) for c in ordered] for n in p.columns]
            if p.kind == "numeric":
                self.sides.append([np.array([np.nan if v is None else v for v in x], np.float64) for x in values])
            else:
                distinct = sorted({v for v in values[0] if v is not None})
                at = {v: k for k, v in enumerate(distinct)}
                self.sides.append((Terms(distinct), np.array([at.get(v, -1) for v in values[0]])))
        self.evaluations = 0  # candidates evaluated in full

    def nearest(self, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(cluster_id, distance) of each point; a point without any distance has NaN."""
        rows, k = block.num_rows, len(self.ids)
        fixed: list = []  # per part: a matrix, or what string distances need
        for p, side in zip(self.parts, self.sides, strict=True):
            if p.kind == "numeric":
                own = [pc.fill_null(block[c].cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in p.columns]
                fixed.append(p.weight * numeric_matrix(p.distance, own, side, self.rescale))
                continue
            coded = pc.dictionary_encode(block[p.columns[0]])
            terms = Terms(coded.dictionary.to_pylist())
            mine = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            other, theirs = side
            longest = np.maximum(np.maximum(terms.length[:, None], other.length[None, :]), 1) if p.distance == "normalizedLevenshtein" else np.ones((1, 1), np.int64)
            longest = np.broadcast_to(longest, (len(terms.length), len(other.length)))
            known = np.full((len(terms.length), len(other.length)), -1, np.int64)
            fixed.append((p.weight, terms, mine, other, theirs, longest, known, least_edits(terms, other)))

        def combined(i: np.ndarray, j: np.ndarray, exact: bool) -> np.ndarray:
            out = None
            for f in fixed:
                if isinstance(f, np.ndarray):
                    d = f[i, j]
                else:
                    weight, terms, mine, other, theirs, longest, known, least = f
                    a, b = mine[i], theirs[j]
                    missing = (a < 0) | (b < 0)
                    if not known.size:
                        d = np.full(np.broadcast(i, j).shape, np.nan)
                    else:
                        if exact:
                            a, b = np.where(missing, 0, a), np.where(missing, 0, b)
                            need = np.unique((a * known.shape[1] + b)[(known[a, b] < 0) & ~missing])
                            x, y = np.divmod(need, known.shape[1])
                            known[x, y] = edits(terms, other, x, y)
                            e = known[a, b]
                        else:
                            e = least[a, b]
                        d = np.where(missing, np.nan, weight * (e.astype(np.float64) / longest[a, b].astype(np.float64)))
                out = d if out is None else out + d
            return out / float(len(fixed))

        bound = combined(np.arange(rows)[:, None], np.arange(k)[None, :], False)
        order = np.argsort(bound, axis=1, kind="stable")  # NaN last
        best, winner = np.full(rows, np.inf), np.full(rows, k)
        live, at = np.arange(rows), np.zeros(rows, np.int64)
        width = 1
        while len(live):
            cols = at[live][:, None] + np.arange(width)
            inside = cols < k
            cand = order[live[:, None], np.minimum(cols, k - 1)]
            low = bound[live[:, None], cand]
            ask = inside & (low <= best[live][:, None])  # False for NaN
            r, c = np.nonzero(ask)
            if len(r):
                own, j = live[r], cand[r, c]
                d = combined(own, j, True)
                self.evaluations += len(d)
                ok = ~np.isnan(d)
                own, j, d = own[ok], j[ok], d[ok]
                s = np.lexsort((j, d, own))
                head = s[np.concatenate([[True], own[s][1:] != own[s][:-1]])] if len(s) else s
                w, dj, jj = own[head], d[head], j[head]
                better = (dj < best[w]) | ((dj == best[w]) & (jj < winner[w]))
                best[w[better]], winner[w[better]] = dj[better], jj[better]
            at[live] += width
            last = np.minimum(at[live], k - 1)
            go = (at[live] < k) & (bound[live, order[live, last]] <= best[live])
            live = live[go]
            width = min(2 * width, 16)
        found = winner < k
        return np.where(found, self.ids[np.minimum(winner, k - 1)], 0), np.where(found, best, np.nan)


def assign_blocks(search: Search, id_col: str, distance_col: str | None):
    """For mapInArrow: all columns, the nearest centroid's id and (unless None) the distance."""
    k = len(search.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, CELLS // k)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                rows = batch.slice(at, size)
                who, d = search.nearest(rows)
                none = np.isnan(d)
                arrays, names = [*rows.columns, pa.array(who, pa.int32(), mask=none)], [*rows.schema.names, id_col]
                if distance_col:
                    arrays, names = [*arrays, pa.array(d, pa.float64(), mask=none)], [*names, distance_col]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run
