"""Cell summaries of 2-D points (K6, A4).

The points are cut into strips of about equal counts by x, and each strip into cells by y (approximate quantiles, which
merge map-side), so a dense place gets many small cells. A cell has a box, a count and sums, taken from its points. The
points themselves, equal ones as one row with their number, are written once as Parquet, partitioned by cell; a large
cell is several files, dealt out by a hash of the point.

Only the summaries of at most MOST_CELLS cells come to the driver. For given centroids a cell is decided if every corner
of its box is nearer to one centroid than to each other; then its count and sums are that centroid's. The points of
the other cells are read by partition pruning, and assigned one by one. As cells are bounded in number, the decided share
depends on where the points lie and on k, not on how many points there are.

Defined cases: a point with a null or NaN coordinate has no nearest centroid and is left out; infinite ones too, as
no box holds them. An empty table has no cells. Further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .assign import assign_2d

PER_CELL = 1 << 16
MOST_CELLS = 64 * 64
ACCURACY = 10_000


@dataclass
class Cells:
    spots: DataFrame          # cell, x, y, n: the distinct points and how many there are, partitioned by cell
    number: np.ndarray        # of each cell, with its
    count: np.ndarray         # points,
    total: np.ndarray         # sums of x and of y,
    low: np.ndarray           # and box
    high: np.ndarray

    def decided(self, centroids: list[tuple[int, float, float]]) -> np.ndarray:
        """For each cell the place of the centroid that is nearest all over its box, or -1."""
        at = np.array([c[1:] for c in centroids], float)
        out = np.full(len(self.number), -1)
        for lot in range(0, len(out), 256):
            low, high = self.low[lot : lot + 256], self.high[lot : lot + 256]
            own = np.argmin(((((low + high) / 2)[:, None] - at[None]) ** 2).sum(2), 1)
            way = at[None] - at[own][:, None]
            # |z - c|^2 - |z - own|^2 over the box is least in the corner towards c
            corner = np.where(way > 0, high[:, None], low[:, None])
            far, near = ((corner - at[None]) ** 2).sum(2), ((corner - at[own][:, None]) ** 2).sum(2)
            clear = far - near > 1e-9 * (far + near)  # a tie, or nearly one, is left to the points
            clear[np.arange(len(own)), own] = True
            out[lot : lot + 256] = np.where(clear.all(1), own, -1)
        return out

    def sums(self, centroids: list[tuple[int, float, float]]) -> tuple[dict[int, tuple[int, float, float]], float]:
        """{cluster_id: (points, sum of x, sum of y)} of the points nearest to each centroid, and the share of points read."""
        own = self.decided(centroids)
        found = {c[0]: (int(self.count[own == j].sum()), *self.total[own == j].sum(0).tolist()) for j, c in enumerate(centroids)}
        if (own < 0).any():
            spots = self.spots.where(F.col("cell").isin(self.number[own < 0].tolist()))
            weighted = assign_2d(spots, centroids).groupBy("cluster_id").agg(
                F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy"))
            for r in weighted.collect():  # k rows
                n, sx, sy = found[r["cluster_id"]]
                found[r["cluster_id"]] = (n + r["n"], sx + r["sx"], sy + r["sy"])
        return found, float(self.count[own < 0].sum() / max(1, self.count.sum()))


def _place(value: Column, edges: list[float]) -> Column:
    """How many of the ascending ``edges`` are below ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) if edges else F.lit(0)


def build_cells(points: DataFrame, x: str = "x", y: str = "y", per_cell: int = PER_CELL) -> Cells:
    """Cells of about ``per_cell`` points, at most MOST_CELLS of them. Four passes over the points: a count, two
    for the edges, and one that writes them; the summaries come from what is written."""
    inf = float("inf")
    points = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = points.where((F.abs("x") < inf) & (F.abs("y") < inf))  # null and NaN are not below
    n = points.count()
    side = min(math.isqrt(MOST_CELLS), max(1, math.isqrt(-(-n // per_cell))))
    cuts = [i / side for i in range(1, side)]
    by_x: list[float] = []
    by_y: dict[int, list[float]] = {}
    if cuts and n:
        by_x = sorted(set(points.agg(F.percentile_approx("x", cuts, ACCURACY)).first()[0]))
        strips = points.withColumn("strip", _place(F.col("x"), by_x)).groupBy("strip").agg(F.percentile_approx("y", cuts, ACCURACY).alias("e"))
        by_y = {r["strip"]: sorted(set(r["e"])) for r in strips.collect()}  # at most side rows of side numbers
    strip = _place(F.col("x"), by_x)
    within = F.lit(0)
    if by_y:
        edges = F.get(F.array(*[F.array(*map(F.lit, by_y.get(i, []))).cast("array<double>") for i in range(len(by_x) + 1)]), F.col("strip"))
        within = F.size(F.filter(edges, lambda e: e < F.col("y")))
    spots = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))  # copies are counted before anything is moved by cell
    spots = spots.withColumn("strip", strip).select((F.col("strip") * side + within).cast("int").alias("cell"), "x", "y", "n")
    files = max(1, -(-n // (MOST_CELLS * 64 * per_cell)))  # parts of a cell, where cells are larger than asked for
    spots = spots.repartition(side * side * files, "cell", F.pmod(F.xxhash64("x", "y"), F.lit(files)))
    spots = written(spots, "cells", partition_by=("cell",))
    rows = spots.groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).orderBy("cell").collect()
    pick = lambda *c: np.array([[r[k] for k in c] for r in rows], float).reshape(-1, len(c))
    return Cells(spots, np.array([r["cell"] for r in rows], int), np.array([r["n"] for r in rows], np.int64),
                 pick("sx", "sy"), pick("x0", "y0"), pick("x1", "y1"))
