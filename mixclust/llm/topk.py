"""Exact top-k search by inner product, as a Voronoi kNN join.

1. PIVOTS vectors (those with the least hash of their id; bounded) split the space: each vector belongs to its
   nearest pivot's cell. Summaries, one row for each cell: number of vectors, radius, the distances of its
   closest k + 1 vectors, number of queries.
2. A query q scores at least ``q.p - |q| d`` with a vector at distance d from pivot p, and at most ``q.p + |q| d``.
   The k-th best of the first over all summaries bounds q's k-th score from below; so a vector at distance
   d of p matters to q only if d >= (bound - q.p) / |q|. The least of that over a group of queries is the
   group's distance bound for the cell.
3. Queries of neighbouring cells form groups of at most GROUP. Each vector goes only to the groups whose bound
   it reaches, in tiles of about TILE vectors; each (group, tile) is solved alone by a block product, and the tiles'
   k best are merged. No task holds more than one tile and one group, however large a cell is. Tiles are
   numbered along the cells, so a tile holds few cells, and a group's queries go, as one packed block, only to tiles that got
   a vector for it.

Defined cases: a vector that is null, or holds a null or a non-finite component, or has a null id takes no
part. Of rows with one id the one with the least vector stands for it. Shorter vectors count as padded with
zeros. Equal scores go to the smaller id. An empty table, or one without queries, gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixclust.session import written

K = 5
SCALE = 256
MOST_PIVOTS = 1024
GROUP = 2048
TILE = 32_768
AT_ONCE = 256
_EXACT = 2.0**53

_CELLS = "vec_id long, cell int, distance double, norm double, v binary"


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), x as double."""
    return np.floor(SCALE * values.astype(np.float64))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of packed 64-bit integers, or lists of components, as doubles."""
    if pa.types.is_binary(col.type):
        return np.frombuffer(b"".join(col.to_pylist()), np.int64).reshape(-1, dims).astype(np.float64)
    size = np.diff(col.offsets.to_numpy())
    flat = integers(col.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(col), dims))
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows, as 64-bit integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def _assign(pivots: np.ndarray, dims: int) -> Callable:
    square = (pivots * pivots).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                rows = b.slice(at, 4096)
                x = matrix(rows["v"], dims)
                cell = np.argmin(square[None] - 2 * (x @ pivots.T), 1)
                distance = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                packed = [y.tobytes() for y in x.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([rows["vec_id"], pa.array(cell, pa.int32()), pa.array(distance), pa.array(np.sqrt((x * x).sum(1))), pa.array(packed, pa.binary())], names=["vec_id", "cell", "distance", "norm", "v"])

    return run


def _bounds(pivots: np.ndarray, cells: np.ndarray, ids: np.ndarray, distances: np.ndarray, radius: np.ndarray, group_of: np.ndarray, parts: np.ndarray, k: int) -> Callable:
    """Of each batch of queries: for each group and cell the least distance from the pivot that matters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = pivots.shape[1]
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                rows = b.slice(at, AT_ONCE)
                q, own, norm = matrix(rows["v"], dims), rows["vec_id"].to_numpy(), np.maximum(rows["norm"].to_numpy(), 1e-9)
                at_pivot = q @ pivots.T
                low = at_pivot[:, cells] - norm[:, None] * distances[None]
                low[ids[None] == own[:, None]] = -np.inf
                low = np.partition(low, -k, 1)[:, -k] if len(cells) >= k else np.full(len(q), -np.inf)
                needed = (low[:, None] - at_pivot) / norm[:, None]
                needed -= 1e-6 * (1 + np.abs(needed))  # for rounding
                group = group_of[rows["cell"].to_numpy()] + split(own, parts[rows["cell"].to_numpy()])
                for g in np.unique(group):
                    least = needed[group == g].min(0)
                    c = np.flatnonzero(least <= radius)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), g), pa.int32()), pa.array(c, pa.int32()), pa.array(least[c], pa.float64())], names=["grp", "cell", "least"])

    return run


def split(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which part of its cell's queries each id is in."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(parts, 1)


def groups(pivots: np.ndarray, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of each cell's queries and how many groups they are split into: neighbouring cells, in
    the order of a chain of nearest pivots, share a group up to ``most`` queries."""
    first, parts = np.zeros(len(queries), np.int64), np.ones(len(queries), np.int64)
    left, at, group, held = set(range(len(queries))), 0, 0, 0
    while left:
        left.discard(at)
        n = int(queries[at])
        if held and held + n > most:
            group, held = group + 1, 0
        first[at] = group
        if n > most:
            parts[at] = -(-n * 5 // (4 * most))
            group, held = group + int(parts[at]), 0
        else:
            held += n
        if left:
            rest = np.fromiter(left, int)
            at = int(rest[np.argmin(((pivots[rest] - pivots[at]) ** 2).sum(1))])
    return first, parts


def _block(t: pa.Table) -> pa.Table:
    """The queries of a group as one row."""
    t = t.sort_by("vec_id").combine_chunks()
    ids = t["vec_id"].to_numpy().astype(np.int64).tobytes()
    return pa.table({"grp": t["grp"].slice(0, 1), "ids": pa.array([ids], pa.binary()), "v": pa.array([b"".join(t["v"].to_pylist())], pa.binary())})


def _solve(dims: int, k: int) -> Callable[[pa.Table], pa.Table]:
    def one(t: pa.Table) -> pa.Table:
        rows = t.filter(pc.is_null(t["ids"])).sort_by("vec_id")
        ids, x = rows["vec_id"].to_numpy(), matrix(rows["v"].combine_chunks(), dims)
        rows = t.filter(pc.is_valid(t["ids"]))  # one
        own, q = np.frombuffer(rows["ids"][0].as_py(), np.int64), matrix(rows["v"].combine_chunks(), dims)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(own) if len(ids) else 0, AT_ONCE):
            scores = products(q[at : at + AT_ONCE], x)
            for i, s in enumerate(scores):
                rival = ids != own[at + i]
                s, c = s[rival], ids[rival]
                if len(s) > k:
                    best = np.flatnonzero(s >= np.partition(s, -k)[-k])
                    best = best[np.argsort(-s[best], kind="stable")[:k]]  # ids are sorted, so ties are too
                    s, c = s[best], c[best]
                out.append((np.full(len(s), own[at + i]), c, s))
        cols = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return one


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.forall("v", fine)).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, queries: F.Column, k: int = K, pivots: int | None = None, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each usable vector that fits ``queries`` (a condition on vec_id)
    the k others with the highest inner product."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = written(usable(vectors), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    if not size["n"]:
        return spark.createDataFrame([], result)
    dims = max(1, size["dims"])
    n_pivots = pivots or int(min(MOST_PIVOTS, max(16, size["n"] ** 0.5)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).toArrow()
    p = np.unique(matrix(chosen["v"].combine_chunks(), dims), axis=0)

    cells = written(rows.mapInArrow(_assign(p, dims), _CELLS), "cells")
    asked = cells.where(queries)
    near = cells.select("cell", "vec_id", "distance", F.row_number().over(Window.partitionBy("cell").orderBy("distance", "vec_id")).alias("at")).where(F.col("at") <= k + 1)
    near = near.select("cell", "vec_id", "distance").toArrow()  # at most k + 1 rows a cell
    radius = np.full(len(p), -np.inf)
    number, held = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    for r in cells.groupBy("cell").agg(F.max("distance").alias("radius"), F.count_if(queries).alias("asked"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], number[r["cell"]], held[r["cell"]] = r["radius"], r["asked"], r["n"]
    first, parts = groups(p, number, group)

    bounds = asked.mapInArrow(_bounds(p, near["cell"].to_numpy(), near["vec_id"].to_numpy(), near["distance"].to_numpy(), radius, first, parts, k), "grp int, cell int, least double")
    routes = bounds.groupBy("grp", "cell").agg(F.min("least").alias("least"))
    # vectors are numbered along the cells, at a hashed place within their own; `tile` numbers make a tile
    along = spark.createDataFrame([(c, int(held[c]), int(held[:c].sum())) for c in range(len(p))], "cell int, held long, begin long")
    reached = cells.join(F.broadcast(along), "cell").join(routes, "cell").where(F.col("distance") >= F.col("least"))
    at = F.col("begin") + F.pmod(F.xxhash64("vec_id"), "held")
    sent = reached.select("grp", F.floor(at / tile).cast("int").alias("tile"), "vec_id", F.lit(None).cast("binary").alias("ids"), "v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, own = b["cell"].to_numpy(), b["vec_id"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[c] + split(own, parts[c]), pa.int32()), b["vec_id"], b["v"]], names=["grp", "vec_id", "v"])

    placed = asked.select("cell", "vec_id", "v").mapInArrow(place, "grp int, vec_id long, v binary")
    blocks = placed.groupBy("grp").applyInArrow(_block, "grp int, ids binary, v binary")
    # reads no vector: which tiles of each group got one
    blocks = sent.select("grp", "tile").distinct().join(blocks, "grp").select("grp", "tile", F.lit(None).cast("long").alias("vec_id"), "ids", "v")
    solved = sent.union(blocks).groupBy("grp", "tile").applyInArrow(_solve(dims, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return solved.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
