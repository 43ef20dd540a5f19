"""The one-pass state of an update: equal to the operators it replaces, in any partitioning."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixclust.operators.assign import build_dictionaries
from mixclust.operators.state import byte_means_of, byte_sums, cluster_states, grouped_states, mean_bytes, means
from mixclust.operators.update import byte_means, first_m_per_cluster
from mixclust.plans import kmeans
from mixclust.plans.geometry import Geometry
from mixclust.plans.kmeans import few_groups, kmeans_mixed, update_partial_sums, update_standard
from mixclust.plans.params import categorical, numeric


def rows(rng, n):
    word = lambda: rng.choice((None, "", *("".join(rng.choice("abé漢z") for _ in range(rng.randint(1, 9))) for _ in range(4))))
    return [(rng.choice((None, *range(n))), rng.randint(0, 5), rng.random() * 10, rng.choice((None, rng.random())), word(), "x" * rng.randint(1, 4)) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_state_equals_the_operators(spark, parts):
    data = rows(random.Random(3), 500)
    df = spark.createDataFrame(data, "id long, cluster_id int, x double, y double, s string, t string").repartition(parts)
    got = cluster_states(df, ["x", "y"], ["s", "t"], order=["id", "s", "t"], sampled=["s", "t"], m=4)
    out = {r.cluster_id: r for r in got.select("cluster_id", "n", *means(got, ["x", "y"]), *byte_means_of(["s", "t"]), "sample").collect()}
    plain = {r.cluster_id: r for r in df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    assert out.keys() == plain.keys()
    for c, r in out.items():
        assert r.n == plain[c].n and r.x == pytest.approx(plain[c].x / r.n) and r.y == pytest.approx(plain[c].y / r.n)
    for col in ("s", "t"):
        counted = df.groupBy("cluster_id", col).agg(F.count(F.lit(1)).alias("__n"))
        assert {r.cluster_id: r[col] for r in byte_means(counted, col).collect()} == {c: r[col] for c, r in out.items()}
    first = {}
    for r in first_m_per_cluster(df, 4, ["id", "s", "t"], ["s", "t"]).orderBy("cluster_id", "__rn").collect():
        first.setdefault(r.cluster_id, []).append((r.id, r.s, r.t))
    assert first == {c: [(v.id, v.s, v.t) for v in r.sample] for c, r in out.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_states_by_way_of_groups(spark, parts):
    df = spark.createDataFrame(rows(random.Random(8), 400), "id long, cluster_id int, x double, y double, s string, t string").repartition(parts)
    df = df.withColumn("y", F.when(F.col("cluster_id") != 2, F.col("y")))
    read = lambda states: {r.cluster_id: r for r in states.select("cluster_id", "n", "seen", "shortest", "bytes", *means(states, ["x", "y"]), *byte_means_of(["s", "t"])).collect()}
    got, expected = read(grouped_states(df, ["x", "y"], ["s", "t"])), read(cluster_states(df, ["x", "y"], ["s", "t"]))
    assert got.keys() == expected.keys() and got[2].y is None
    for c, r in got.items():
        assert [r[k] for k in ("n", "seen", "shortest", "bytes", "s", "t")] == [expected[c][k] for k in ("n", "seen", "shortest", "bytes", "s", "t")]
        assert (r.x, r.y) == pytest.approx((expected[c].x, expected[c].y))
    assert grouped_states(df.where("false"), ["x"], ["s"]).collect() == []


def test_groups_only_where_dictionaries_bound_them(spark, monkeypatch):
    df = spark.createDataFrame([(i, i / 9, "ab" * (1 + i % 3), f"u{i % 7}") for i in range(60)], "id int, x double, t string, u string").persist()
    geom = Geometry((numeric("x"), categorical("t"), categorical("u")), {"x": 0.4, "t": 0.3, "u": 0.3}, 1)
    seeds = [{"cluster_id": i, "x": i / 2, "t": "ab", "u": f"u{i}"} for i in range(3)]
    dicts = build_dictionaries(df, geom, "dictionary", 60, k=3)
    assert few_groups(geom, dicts, 3) and not few_groups(geom, {"t": dicts["t"]}, 3)
    first = kmeans_mixed(df, seeds, geom, "PartialSums", -1.0, 2, dictionaries=dicts)
    monkeypatch.setattr(kmeans, "MOST_GROUPS", 62)
    assert not few_groups(geom, dicts, 3)
    second = kmeans_mixed(df, seeds, geom, "PartialSums", -1.0, 2, dictionaries=dicts)
    for a, b in zip(first.centroids, second.centroids, strict=True):
        assert {**a, "x": 0} == {**b, "x": 0} and a["x"] == pytest.approx(b["x"])


def test_byte_sums_merge_in_any_order():
    col = pa.array(["abc", None, "ab", "zz", "é", ""])
    least, sums = byte_sums(col, np.array([0, 0, 0, 1, 1, 2]), 4, np.full(4, -1))
    assert least.tolist() == [2, 2, 0, -1]
    assert sums[0, :2].tolist() == [97 + 97, 98 + 98] and sums[1, :2].tolist() == [122 - 61, 122 - 87]
    least, sums = byte_sums(col, np.array([0, 0, 0, 1, 1, 2]), 4, np.array([1, 5, -1, 0]))
    assert least.tolist() == [1, 2, 0, 0] and sums[0, 0] == 194
    assert mean_bytes(np.array([-7, 7, 300]), 2) == bytes([253, 3, 150])  # truncated toward zero


@pytest.mark.parametrize("update,m", [(update_partial_sums, 1), (update_standard, 3)])
def test_an_iteration_persists_nothing_and_explodes_no_bytes(spark, update, m):
    df = spark.createDataFrame([(i, i % 2, float(i), "ab" * (1 + i % 3)) for i in range(20)], "id int, cluster_id int, x double, t string")
    geom = Geometry((numeric("x"), categorical("t")), {"x": 0.5, "t": 0.5}, m)
    scratch = []
    plan = update(df, geom, ["id"], scratch)._jdf.queryExecution().executedPlan().toString()
    assert scratch == [] and "InMemory" not in plan
    if update is update_partial_sums:
        assert "Generate" not in plan and "explode" not in plan and plan.count("Scan ExistingRDD") <= 1


def test_all_strings_missing(spark):
    df = spark.createDataFrame([(1, 0.0, ""), (2, 1.0, "")], "id int, x double, t string")
    geom = Geometry((numeric("x"), categorical("t")), {"x": 0.5, "t": 0.5}, 1)
    res = kmeans_mixed(df, [{"cluster_id": 0, "x": 0.0, "t": ""}], geom, "PartialSums", -1.0, 1)
    assert res.centroids == [{"cluster_id": 0, "x": 0.5, "t": ""}]
