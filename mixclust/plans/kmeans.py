"""Iterative k-means drivers (K3, K4, K5, K6).

Each iteration is one Spark action whose result has at most k rows (new centroids and
their movement); the centroids re-enter the next iteration as literals, so the plan does
not grow with the iterations and nothing but k rows ever reaches the driver. The points
must be persisted by the caller (they are scanned once per iteration).
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assign import TermDictionary, anchor_2d, assign, assign_2d, assign_bounded_2d, build_dictionaries
from ..operators.cells import PER_CELL, build_cells
from ..operators.state import byte_means_of, cluster_states, grouped_states, means
from ..operators.update import centroids_frame, cluster_sums, keep_empty, mean_centroids, medoids_of, with_movement
from .geometry import Geometry


# combinations of cluster and terms up to which points are summed by them first: far below a task's points at scale
MOST_GROUPS = 50_000


@dataclass
class KMeansResult:
    centroids: list[dict]            # scaled space, sorted by cluster_id
    iterations: int
    movements: list[dict[int, float]] = field(default_factory=list)
    seconds: list[float] = field(default_factory=list)
    evaluated: list[float] = field(default_factory=list)  # 2-D: share of points whose distances were computed


def _rows(df: DataFrame) -> list[dict]:
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["cluster_id"])


def update_standard(assigned: DataFrame, geom: Geometry, order_cols: Sequence[str], scratch: list[DataFrame]) -> DataFrame:
    """K3 update: means over all points + medoids over the first m points (by id, then
    terms). With m = 1 the medoid is the first point's term itself, so it rides along in
    the means aggregation as min(struct(id, terms)) and the iteration is a single pass.
    With m > 1 the first m points of each cluster are kept beside the sums, in the same pass."""
    if not geom.use_categoricals or not geom.categoricals:
        return mean_centroids(cluster_sums(assigned, geom.numeric_columns), geom.numeric_columns)
    cats = geom.categorical_columns
    if geom.samples_for_medoid == 1:
        first = F.min(F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in cats])).alias("__first")
        agg = assigned.groupBy("cluster_id").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"__s_{c}") for c in geom.numeric_columns], first)
        return agg.select("cluster_id", "n", *[(F.col(f"__s_{c}") / F.col("n")).alias(c) for c in geom.numeric_columns],
                          *[F.col(f"__first.{c}").alias(c) for c in cats])
    # k rows, with the sample: they are read twice by the medoids' pairs
    sample_order = list(dict.fromkeys([*order_cols, *cats]))
    states = cluster_states(assigned, geom.numeric_columns, order=sample_order, sampled=cats, m=geom.samples_for_medoid)
    states = assigned.sparkSession.createDataFrame(states.collect(), states.schema)
    sample = states.select("cluster_id", F.posexplode("sample").alias("__rn", "__s")).select("cluster_id", (F.col("__rn") + 1).alias("__rn"), "__s.*")
    return states.select("cluster_id", "n", *means(states, geom.numeric_columns)).join(medoids_of(sample, geom), "cluster_id", "left")


def few_groups(geom: Geometry, dictionaries: dict[str, TermDictionary], k: int) -> bool:
    """Whether the dictionaries bound the combinations of cluster and terms by MOST_GROUPS."""
    cats = geom.categorical_columns
    return all(c in dictionaries for c in cats) and k * math.prod(dictionaries[c].n_terms for c in cats) <= MOST_GROUPS


def update_partial_sums(assigned: DataFrame, geom: Geometry, order_cols: Sequence[str], scratch: list[DataFrame], grouped: bool = False) -> DataFrame:
    """K4 update: one pass that keeps sums, counts and byte sums cut to the shortest term per cluster and task; with
    ``grouped`` by cluster and terms on the JVM first."""
    cats = geom.categorical_columns if geom.use_categoricals else []
    if not cats:
        return mean_centroids(cluster_sums(assigned, geom.numeric_columns), geom.numeric_columns)
    states = (grouped_states if grouped else cluster_states)(assigned, geom.numeric_columns, cats)
    return states.select("cluster_id", "n", *means(states, geom.numeric_columns), *byte_means_of(cats))


UPDATES = {"Standard": update_standard, "PartialSums": update_partial_sums}


def kmeans_mixed(points: DataFrame, seeds: list[dict], geom: Geometry, mode: str = "PartialSums",
                 epsilon: float = 0.001, max_iter: int = 2, order_cols: Sequence[str] = ("id",),
                 plan: str = "auto", n_points: int | None = None, empty: str = "drop",
                 dictionaries: dict[str, TermDictionary] | None = None, done: KMeansResult | None = None,
                 after: Callable[[int, list[dict], dict[int, float], float], None] | None = None) -> KMeansResult:
    """K3 (mode 'Standard') / K4 (mode 'PartialSums') on scaled points.

    Iteration i (from 1) assigns, updates, measures the movement of every centroid and
    goes on iff some movement > epsilon and i < max_iter; the centroids of the last update
    are returned. A cluster without points is dropped, or (empty='keep') keeps its centroid.
    Points without a nearest centroid take no part in the update. Dictionaries that are
    passed in stay the caller's to release. ``done``: iterations of an earlier run, from which this
    one goes on. ``after`` is called at the end of each iteration with its number, centroids, movements and seconds.
    """
    update = geom.updates.get(mode) or UPDATES.get(mode)
    if update is None:
        raise ValueError(f"mode must be one of {sorted({*UPDATES, *geom.updates})}, got {mode!r}")
    if empty not in ("drop", "keep"):
        raise ValueError(f"empty must be 'drop' or 'keep', got {empty!r}")
    spark = points.sparkSession
    own = dictionaries is None
    if own:
        dictionaries = build_dictionaries(points, geom, plan, n_points, k=len(seeds))
    if update is update_partial_sums and few_groups(geom, dictionaries, len(seeds)):
        update = partial(update_partial_sums, grouped=True)
    columns = [*geom.numeric_columns, *geom.categorical_columns]
    goes_on = lambda it, moves: it < max_iter and any(m is not None and m > epsilon for m in moves.values())
    centroids = sorted(seeds, key=lambda c: c["cluster_id"])
    movements: list[dict[int, float]] = []
    seconds: list[float] = []
    it = 1
    try:
        if done is not None and done.iterations:
            if not goes_on(done.iterations, done.movements[-1]):
                return done
            centroids, it = done.centroids, done.iterations + 1
            movements, seconds = [*done.movements], [*done.seconds]
        while True:
            t0 = time.perf_counter()
            assigned = assign(points, centroids, geom, dictionaries, distance_col=None).where("cluster_id IS NOT NULL")
            scratch: list[DataFrame] = []
            new = update(assigned, geom, order_cols, scratch)
            old = centroids_frame(spark, centroids, geom, prefix="o_")
            if empty == "keep":
                have = set(new.columns)
                new = new.withColumns({c: F.lit(None).cast("string") for c in columns if c not in have})
                new = keep_empty(old, new, columns).select("cluster_id", *columns)
            rows = _rows(with_movement(new, old, geom))
            for df in scratch:
                df.unpersist()
            moves = {r["cluster_id"]: r["movement"] for r in rows}
            movements.append(moves)
            seconds.append(time.perf_counter() - t0)
            centroids = [{k: v for k, v in r.items() if k not in ("movement", "n")} for r in rows]
            for c in centroids:
                for name in geom.categorical_columns:
                    c.setdefault(name, None)
            if after is not None:
                after(it, centroids, moves, seconds[-1])
            if goes_on(it, moves):
                it += 1
                continue
            return KMeansResult(centroids, it, movements, seconds)
    finally:
        if own:
            for td in dictionaries.values():
                td.release()


# drop bounds when an iteration computed distances for more than this share of the points
RENEW_SHARE = 0.25
# take bounds when the longest way of a centroid is below this share of the mean half distance to the next centroid
SETTLED = 0.1


def settled(cents: list[tuple[int, float, float]], moves: dict[int, float]) -> bool:
    """Whether bounds taken now are likely to last."""
    if len(cents) < 2:
        return True
    at = np.array([c[1:] for c in cents])
    half = [np.sort(np.hypot(*(at - c).T))[1] / 2 for c in at]
    return max(moves.values()) < SETTLED * float(np.mean(half))


def kmeans_2d(points: DataFrame, init: Sequence[tuple[float, float]], epsilon: float = 0.1,
              x: str = "x", y: str = "y", max_iter: int | None = None, bounds: bool = True) -> KMeansResult:
    """K5/K6: plain 2-D k-means; a cluster without points keeps its centroid; stops when
    no centroid moved more than epsilon (max_iter is an optional safety cap).

    With ``bounds`` each point's distances to its two nearest centroids are kept from an iteration on in which the
    centroids have settled (x, y and three numbers a point are persisted there), and later ones compute distances only
    where the centroids' ways since then leave the nearest open; above RENEW_SHARE of the points the bounds are dropped,
    and taken anew. ``evaluated`` of the result is the share of points whose distances were computed, by iteration."""
    cents = [(i, float(cx), float(cy)) for i, (cx, cy) in enumerate(init)]
    movements: list[dict[int, float]] = []
    evaluated: list[float] = []
    anchored, anchors, renew = None, cents, False
    try:
        while True:
            if renew:
                anchored, anchors = anchor_2d(points, cents, x, y).persist(StorageLevel.MEMORY_AND_DISK), cents
                assigned = anchored.select(x, y, F.col("anchor_id").alias("cluster_id"), F.lit(False).alias("certain"))
            elif anchored is not None:
                assigned = assign_bounded_2d(anchored, anchors, cents, x, y)
            else:
                assigned = assign_2d(points, cents, x, y).withColumn("certain", F.lit(False))
            found = assigned.groupBy("cluster_id").agg(
                F.avg(x).alias("nx"), F.avg(y).alias("ny"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("certain")).alias("open"))
            rows = {r["cluster_id"]: r for r in found.collect()}  # k rows, and one of points without a centroid
            n = sum(r["n"] for r in rows.values())
            evaluated.append(sum(r["open"] for r in rows.values()) / n if n else 0.0)
            cents, moves = moved_2d(cents, {c: (r["nx"], r["ny"]) for c, r in rows.items() if c is not None})
            movements.append(moves)
            if anchored is not None and not renew and evaluated[-1] > RENEW_SHARE:
                anchored.unpersist()
                anchored = None
            renew = bounds and anchored is None and settled(cents, moves)
            if not any(m > epsilon for m in moves.values()) or (max_iter is not None and len(movements) >= max_iter):
                return KMeansResult([{"cluster_id": c, x: cx, y: cy} for c, cx, cy in cents], len(movements), movements, evaluated=evaluated)
    finally:
        if anchored is not None:
            anchored.unpersist()


def moved_2d(cents: list[tuple[int, float, float]], means: dict[int, tuple[float, float]]) -> tuple[list[tuple[int, float, float]], dict[int, float]]:
    """The centroids after an update, and the way of each; one without a mean stays."""
    new = [(c, *means.get(c, (ox, oy))) for c, ox, oy in cents]
    return new, {c: math.sqrt((nx - ox) ** 2 + (ny - oy) ** 2) for (c, ox, oy), (_, nx, ny) in zip(cents, new, strict=True)}


def kmeans_2d_cells(points: DataFrame, init: Sequence[tuple[float, float]], epsilon: float = 0.1, x: str = "x", y: str = "y",
                    max_iter: int | None = None, per_cell: int = PER_CELL) -> KMeansResult:
    """K6 on cells: the points are laid out once as a table by cell (operators/cells.py). An iteration assigns a cell whose
    box has one nearest centroid as a whole, by its count and sums, and reads the points of the other cells only.
    Result as kmeans_2d, but for the order of summation; ``evaluated`` is the share of points that were read."""
    cells = build_cells(points, x, y, per_cell)
    cents = [(i, float(cx), float(cy)) for i, (cx, cy) in enumerate(init)]
    movements: list[dict[int, float]] = []
    evaluated: list[float] = []
    while True:
        sums, read = cells.sums(cents)
        evaluated.append(read)
        cents, moves = moved_2d(cents, {c: (sx / n, sy / n) for c, (n, sx, sy) in sums.items() if n})
        movements.append(moves)
        if not any(m > epsilon for m in moves.values()) or (max_iter is not None and len(movements) >= max_iter):
            return KMeansResult([{"cluster_id": c, x: cx, y: cy} for c, cx, cy in cents], len(movements), movements, evaluated=evaluated)


def local_init(points: DataFrame, order_col: str, positions: Sequence[int], x: str = "x", y: str = "y"):
    """K6's start: the points at the given positions of the `order_col` order (a bounded
    top-N, max(positions)+1 rows reach the driver)."""
    top = points.orderBy(order_col).limit(max(positions) + 1).select(x, y).collect()
    return [(top[p][x], top[p][y]) for p in positions]
