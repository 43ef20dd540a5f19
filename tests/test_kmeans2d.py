"""FIXTURES.md §3: 2-D k-means on the 7 sample points; empties kept, ties to the later."""

import os

import pytest
from pyspark.sql import functions as F

from mixclust.operators.assign import anchor_2d, assign_2d, assign_bounded_2d
from mixclust.operators.cells import build_cells
from mixclust.plans.kmeans import RENEW_SHARE, kmeans_2d, kmeans_2d_cells, local_init
from mixclust.sources.points_text import read_points_text

from .conftest import DATA


def points(spark):
    pts, bad = read_points_text(spark, os.path.join(DATA, "points7.txt"))
    assert bad.count() == 0
    return pts


def test_local_init_start(spark):
    pts = points(spark).withColumn("pos", F.monotonically_increasing_id())
    init = local_init(pts, "pos", (0, 2, 6))
    assert init == [(1.0, 1.0), (3.0, 4.0), (3.5, 4.5)]
    res = kmeans_2d(pts, init, epsilon=0.1)
    assert res.iterations == 4
    got = [(round(c["x"], 6), round(c["y"], 6)) for c in res.centroids]
    assert got == [(1.25, 1.5), (3.333333, 4.5), (4.75, 6.0)]
    moves = [[round(m[i], 6) for i in range(3)] for m in res.movements]
    assert moves[0] == [0.559017, 0.0, 1.075291]
    assert moves[3] == [0.0, 0.0, 0.0]
    sizes = assign_2d(pts, [(c["cluster_id"], c["x"], c["y"]) for c in res.centroids]).groupBy("cluster_id").count()
    assert sorted((r[0], r[1]) for r in sizes.collect()) == [(0, 2), (1, 3), (2, 2)]


def test_fixed_start(spark):
    res = kmeans_2d(points(spark), [(1.5, 5.0), (2.5, 3.0), (1.5, 1.0)], epsilon=0.1)
    assert res.iterations == 3
    assert [(round(c["x"], 6), round(c["y"], 6)) for c in res.centroids] == [(5.0, 7.0), (3.625, 4.625), (1.25, 1.5)]


def test_empty_cluster_keeps_centroid(spark):
    res = kmeans_2d(points(spark), [(1.0, 1.0), (100.0, 100.0)], epsilon=0.1, max_iter=5)
    assert (res.centroids[1]["x"], res.centroids[1]["y"]) == (100.0, 100.0)


def test_tie_goes_to_later_centroid(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    out = assign_2d(df, [(0, -1.0, 0.0), (1, 1.0, 0.0)]).first()
    assert out.cluster_id == 1


def test_text_scan_rejects(spark, tmp_path):
    p = tmp_path / "pts.txt"
    p.write_text("1.0 2.0 extra\nbad line\n3 4\n")
    good, bad = read_points_text(spark, str(p))
    assert sorted(tuple(r) for r in good.collect()) == [(1.0, 2.0), (3.0, 4.0)]
    assert [r.value for r in bad.collect()] == ["bad line"]


def test_squared_distances_never_rise_and_agree_with_mllib(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    from mixclust.operators.assign import assign_2d

    pts = spark.range(400).select(((F.col("id") * 37) % 101 / 101.0).alias("x"), ((F.col("id") * 53) % 97 / 97.0).alias("y")).cache()
    start = [(0.1, 0.1), (0.5, 0.9), (0.9, 0.2)]
    last = None
    for n in range(1, 7):
        res = kmeans_2d(pts, start, epsilon=-1.0, max_iter=n)
        cents = [(c["cluster_id"], c["x"], c["y"]) for c in res.centroids]
        cost = assign_2d(pts, cents, distance_col="d").agg(F.sum(F.col("d") * F.col("d"))).first()[0]
        assert last is None or cost <= last + 1e-9
        last = cost
    res = kmeans_2d(pts, start, epsilon=1e-9, max_iter=200)
    vec = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(pts)
    costs = [KMeans(k=3, seed=s, maxIter=200, tol=1e-9).fit(vec).summary.trainingCost for s in range(3)]
    cents = [(c["cluster_id"], c["x"], c["y"]) for c in res.centroids]
    cost = assign_2d(pts, cents, distance_col="d").agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    assert cost <= 1.2 * min(costs)


def lumps(spark, n=6000):
    """Points in four places, a third of them equal, and some without a coordinate."""
    x = F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise((F.col("id") * 7919 % 1009) / 4036.0 + (F.col("id") % 2) * 0.7)
    y = F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise((F.col("id") * 104729 % 997) / 3988.0 + (F.col("id") % 4 > 1).cast("int") * 0.7)
    pts = spark.range(n).select(x.alias("x"), y.alias("y"))
    return pts.union(spark.createDataFrame([(None, 1.0), (float("nan"), 0.5)], "x double, y double"))


START = [(0.1, 0.1), (0.9, 0.2), (0.3, 0.8), (0.7, 0.9), (0.5, 0.5)]


def test_bounds_give_the_same_iterations_and_fewer_distances(spark):
    pts = spark.range(6000).select((F.col("id") * 7919 % 1009 / 1009.0).alias("x"), (F.col("id") * 104729 % 997 / 997.0).alias("y")).cache()
    start = [(0.1, 0.1), (0.15, 0.1), (0.1, 0.2), (0.2, 0.2)]
    plain = kmeans_2d(pts, start, epsilon=1e-4, max_iter=40, bounds=False)
    bound = kmeans_2d(pts, start, epsilon=1e-4, max_iter=40)
    assert plain.iterations == bound.iterations > 4
    for a, b in zip(plain.centroids, bound.centroids, strict=True):
        assert (a["x"], a["y"]) == (pytest.approx(b["x"], abs=1e-12), pytest.approx(b["y"], abs=1e-12))
    assert set(plain.evaluated) == {1.0}
    assert bound.evaluated[0] == 1.0 and bound.evaluated[-1] < RENEW_SHARE and sum(bound.evaluated) < 0.6 * bound.iterations


def test_bounds_leave_ties_to_the_distances(spark):
    anchors, moved = [(0, -1.0, 0.0), (1, 2.0, 0.0)], [(0, -1.0, 0.0), (1, 1.0, 0.0)]
    pts = spark.createDataFrame([(0.0, 0.0), (-0.9, 0.0), (None, 0.0)], "x double, y double")
    rows = assign_bounded_2d(anchor_2d(pts, anchors), anchors, moved).collect()
    assert [(r.x, r.cluster_id, r.certain) for r in rows] == [(0.0, 1, False), (-0.9, 0, True), (None, None, False)]
    alone = [(0, 5.0, 5.0)]
    assert [(r.cluster_id, r.certain) for r in assign_bounded_2d(anchor_2d(pts, alone), alone, [(0, 9.0, 9.0)]).collect()] == [(0, True), (0, True), (None, False)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_cells_give_the_same_centroids(spark, parts):
    pts = lumps(spark).repartition(parts)
    plain = kmeans_2d(pts, START, epsilon=-1.0, max_iter=6, bounds=False)
    cells = kmeans_2d_cells(pts, START, epsilon=-1.0, max_iter=6, per_cell=60)
    for a, b in zip(plain.centroids, cells.centroids, strict=True):
        assert (a["x"], a["y"]) == (pytest.approx(b["x"], abs=1e-12), pytest.approx(b["y"], abs=1e-12))
    assert cells.evaluated[-1] < 0.4  # of 10 by 10 cells most have one nearest centroid


def test_cells_hold_every_point_once_and_read_only_what_is_open(spark):
    pts = lumps(spark)
    cells = build_cells(pts, per_cell=60)
    assert cells.count.sum() == 6000 and len(cells.number) > 40
    assert cells.spots.agg(F.sum("n")).first()[0] == 6000
    assert cells.spots.where("x = 0.25 and y = 0.25").count() == 1  # equal points are one row
    own = cells.decided([(0, 0.1, 0.1), (1, 0.9, 0.9)])
    near = assign_2d(cells.spots, [(0, 0.1, 0.1), (1, 0.9, 0.9)]).where(F.col("cell").isin(cells.number[own == 1].tolist()))
    assert {r[0] for r in near.select("cluster_id").distinct().collect()} == {1}
    plan = cells.spots.where(F.col("cell").isin(cells.number[own < 0].tolist()))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_cells_of_no_and_of_equal_points(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert kmeans_2d_cells(empty, [(1.0, 2.0)]).centroids == [{"cluster_id": 0, "x": 1.0, "y": 2.0}]
    same = spark.range(500).select(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    res = kmeans_2d_cells(same, [(0.0, 0.0), (9.0, 9.0)], per_cell=10)
    assert [(c["x"], c["y"]) for c in res.centroids] == [(3.0, 4.0), (9.0, 9.0)]
