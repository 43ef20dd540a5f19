"""Byte-mean strings (A8), medoids (A7) and invariants of the k-means loop."""

import pytest
from pyspark.sql import functions as F

from mixclust.operators.assign import assign, build_dictionaries
from mixclust.functions.distances import register_distance
from mixclust.operators.scaling import coord_limits, fetch_limits, minmax_scale, unscale
from mixclust.operators.seeds import sample_seeds
from mixclust.operators.update import byte_means, medoids
from mixclust.plans.geometry import Geometry
from mixclust.plans.kmeans import kmeans_mixed
from mixclust.plans.params import ClusterParams, SPAM_FEATURES, categorical, numeric

from .conftest import SPAM_WEIGHTS


def bm(spark, terms):
    df = spark.createDataFrame([(0, t, 1) for t in terms], "cluster_id int, t string, __n long")
    return byte_means(df, "t").first()["t"]


@pytest.mark.parametrize("terms,expected", [
    (["abc", "cde f", "x"], "i"),
    (["Grum", "Rustock"], "Lstp"),
    (["hé", "hé!"], "hé"),
    (["", "abc"], ""),
])
def test_byte_mean(spark, terms, expected):
    assert bm(spark, terms) == expected


def test_byte_mean_counts_duplicates(spark):
    df = spark.createDataFrame([(0, "a", 3), (0, "c", 1)], "cluster_id int, t string, __n long")
    assert byte_means(df, "t").first()["t"] == chr((97 * 3 + 99) // 4)


def test_medoid_first_m_by_id_ties_to_later(spark):
    geom = Geometry((numeric("x"), categorical("t")), {"x": 0.5, "t": 0.5}, 2)
    df = spark.createDataFrame([(1, 0, 0.0, "ab"), (2, 0, 0.0, "cd"), (3, 0, 0.0, "ab")],
                               "id int, cluster_id int, x double, t string")
    # sample = ids 1, 2: both have mean distance 0.5 -> the later one wins
    assert medoids(df, geom, 2, ["id"]).first()["t"] == "cd"
    assert medoids(df, geom, 3, ["id"]).first()["t"] == "ab"


def test_weights_are_matched_by_name():
    with pytest.raises(ValueError):
        Geometry(SPAM_FEATURES, {**SPAM_WEIGHTS, "extra": 0.0}, 1)
    with pytest.raises(ValueError):
        Geometry(SPAM_FEATURES, {k: v for k, v in SPAM_WEIGHTS.items() if k != "uri"}, 1)
    with pytest.raises(ValueError):
        Geometry(SPAM_FEATURES, {**SPAM_WEIGHTS, "uri": 0.5}, 1)
    with pytest.raises(ValueError):
        ClusterParams(mode="Fast", weights=SPAM_WEIGHTS).validate(SPAM_FEATURES)
    with pytest.raises(ValueError):
        ClusterParams(samples_for_medoid=1, weights={"x": 1.0}).validate((numeric("x"),))


def test_unscale_roundtrip_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (2.0, 7.0)], "a double, b double")
    lim = fetch_limits(df, ["a", "b"])
    sc = minmax_scale(df, lim)
    assert sorted(r.b for r in sc.collect()) == [0.0, 0.0, 0.0]
    back = unscale(sc, lim)
    assert sorted((r.a, r.b) for r in back.collect()) == [(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)]


def _seeds(rows, idx):
    return [{k: v for k, v in dict(rows[i], cluster_id=j).items() if k != "id"} for j, i in enumerate(idx)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_independent_of_partitioning(spam, parts):
    pts, _, rows = spam
    geom = Geometry(SPAM_FEATURES, SPAM_WEIGHTS, 3)
    base = kmeans_mixed(pts, _seeds(rows, [0, 2, 4]), geom, "Standard", 0.001, 20)
    other = kmeans_mixed(pts.repartition(parts), _seeds(rows, [0, 2, 4]), geom, "Standard", 0.001, 20)
    r12 = lambda cs: [{k: round(v, 12) if isinstance(v, float) else v for k, v in c.items()} for c in cs]
    assert r12(base.centroids) == r12(other.centroids) and base.iterations == other.iterations


def test_sizes_sum_and_equal_seeds(spam):
    pts, _, rows = spam
    geom = Geometry(SPAM_FEATURES, SPAM_WEIGHTS, 1)
    seeds = _seeds(rows, [0, 0, 4])  # two equal seeds: the earlier never wins a point
    a = assign(pts, seeds, geom, build_dictionaries(pts, geom, "dictionary"))
    sizes = {r.cluster_id: r["count"] for r in a.groupBy("cluster_id").count().collect()}
    assert sum(sizes.values()) == 10 and 0 not in sizes
    res = kmeans_mixed(pts, seeds, geom, "PartialSums", 0.001, 5)
    assert [c["cluster_id"] for c in res.centroids] == [1, 2]  # the empty cluster is dropped


def test_single_centroid_and_one_point(spark, spam):
    pts, _, rows = spam
    geom = Geometry(SPAM_FEATURES, SPAM_WEIGHTS, 1)
    res = kmeans_mixed(pts, _seeds(rows, [3]), geom, "Standard", 0.001, 3)
    assert len(res.centroids) == 1
    one = pts.where(F.col("id") == rows[5]["id"])
    res = kmeans_mixed(one, _seeds(rows, [5]), geom, "PartialSums", 0.001, 3)
    assert res.iterations == 1 and res.centroids[0]["bot"] == rows[5]["bot"]


@pytest.mark.parametrize("mode", ["Standard", "PartialSums"])
def test_partial_sums_and_standard_ignore_partitioning_and_plan(spam, mode, monkeypatch):
    pts, _, rows = spam
    geom = Geometry(SPAM_FEATURES, SPAM_WEIGHTS, 2)
    base = kmeans_mixed(pts, _seeds(rows, [0, 2, 4]), geom, mode, 0.001, 5, plan="inline")
    monkeypatch.setattr("mixclust.operators.assign.MOST_LITERALS", 1)  # the plan for many centroids
    for plan in ("inline", "dictionary"):
        other = kmeans_mixed(pts.repartition(7), _seeds(rows, [0, 2, 4]), geom, mode, 0.001, 5, plan=plan)
        assert [c["uri"] for c in base.centroids] == [c["uri"] for c in other.centroids]
        for a, b in zip(base.centroids, other.centroids):
            assert a["time"] == pytest.approx(b["time"]) and a["ip"] == pytest.approx(b["ip"])


def test_null_distances_never_win(spark):
    geom = Geometry((numeric("v", "x", "y", distance="cosine"),), {"v": 1.0}, 0)
    pts = spark.createDataFrame([(1, 1.0, 0.1), (2, 0.1, 1.0), (3, None, 1.0), (4, 0.0, 0.0)], "id int, x double, y double")
    cents = [{"cluster_id": 0, "x": 0.0, "y": 0.0}, {"cluster_id": 1, "x": 1.0, "y": 0.0}, {"cluster_id": 2, "x": 0.0, "y": 1.0}]
    for many in (cents, cents + [dict(cents[0], cluster_id=i) for i in range(3, 50)]):
        got = {r.id: (r.cluster_id, r.distance is None) for r in assign(pts, many, geom).collect()}
        assert got == {1: (1, False), 2: (2, False), 3: (None, True), 4: (None, True)}
    res = kmeans_mixed(pts, cents, geom, "Standard", -1.0, 1)
    assert [c["cluster_id"] for c in res.centroids] == [1, 2]
    kept = kmeans_mixed(pts, cents, geom, "Standard", -1.0, 1, empty="keep")
    assert [c["cluster_id"] for c in kept.centroids] == [0, 1, 2] and kept.centroids[0]["x"] == 0.0


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_seeds_of_equal_ids(spark, parts):
    df = spark.range(200).selectExpr("'0' AS id", "CAST(id AS DOUBLE) AS x", "concat('t', id % 7) AS t")
    got = [(r.x, r.t) for r in sample_seeds(df.repartition(parts), 3).orderBy("cluster_id").collect()]
    assert got == [(r.x, r.t) for r in sample_seeds(df.coalesce(1), 3).orderBy("cluster_id").collect()]


def test_more_seeds_than_points_and_empty_input(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")
    assert sample_seeds(df, 5).count() == 2
    with pytest.raises(ValueError, match="empty or all NULL"):
        fetch_limits(df.where("x > 9"), ["x"])


def test_further_distance_update_and_reducer(spark):
    register_distance("numeric", "largest", lambda a, b: F.greatest(*[F.abs(x - y) for x, y in zip(a, b)]))
    half = lambda assigned, geom, order, scratch: assigned.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), *[(F.avg(c) / 2).alias(c) for c in geom.numeric_columns])
    geom = Geometry((numeric("v", "x", "y", distance="largest"),), {"v": 1.0}, 0, updates={"halves": half})
    pts = spark.createDataFrame([(1, 0.0, 3.0), (2, 2.0, 5.0)], "id int, x double, y double")
    res = kmeans_mixed(pts, [{"cluster_id": 0, "x": 0.0, "y": 0.0}], geom, "halves", -1.0, 1)
    assert (res.centroids[0]["x"], res.centroids[0]["y"]) == (0.5, 2.0)
    assert res.movements[0][0] == pytest.approx(2.0 / 2 ** 0.5)
    row = coord_limits(pts, ["x"], (("spread", lambda c: F.max(c) - F.min(c)),)).first()
    assert row["spread_x"] == 2.0
    assert ClusterParams(mode="halves", samples_for_medoid=0, weights={"v": 1.0}).validate(geom.features, geom.updates) == {"v": 1.0}
