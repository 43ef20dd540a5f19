"""Golden values of the Column builders (FIXTURES.md §2)."""

import math

import pytest
from pyspark.sql import functions as F

import mixclust.functions as MF
from mixclust.functions.distances import numeric_distance, string_distance


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_ip_to_long_and_back(spark):
    assert one(spark, MF.ip_to_long(F.lit("83.149.45.128"))) == 1402285440
    assert one(spark, MF.ip_to_long(F.lit("118.131.117.245"))) == 1988326901
    assert one(spark, MF.long_to_ip(F.lit(1402285440))) == "83.149.45.128"
    assert one(spark, MF.long_to_ip(F.lit(1402285440.9))) == "83.149.45.128"
    assert one(spark, MF.ip_to_long(F.lit(""))) == 0
    assert one(spark, MF.ip_to_long(F.lit("0.0.0.0"))) == 0


@pytest.mark.parametrize("bad", ["fe80::1", "mail.example.com", "1.2.3", "1.2.3.256", "1.2.3.4.5"])
def test_ip_to_long_rejects(spark, bad):
    assert one(spark, MF.ip_to_long(F.lit(bad))) is None


def test_levenshtein(spark):
    assert one(spark, MF.levenshtein(F.lit("Grum"), F.lit("Rustock"))) == 7
    assert one(spark, MF.normalized_levenshtein(F.lit("Grum"), F.lit("Rustock"))) == 1.0
    assert round(one(spark, MF.normalized_levenshtein(F.lit("Unclassified"), F.lit("Maazben"))), 6) == 0.833333
    assert one(spark, MF.normalized_levenshtein(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, MF.normalized_levenshtein(F.lit(""), F.lit("ab"))) == 1.0


def test_ip_similarity(spark):
    assert one(spark, MF.ip_similarity(F.lit("82.4.229.158"), F.lit("82.200.1.214"))) == 0.30859375
    assert one(spark, MF.ip_similarity(F.lit("83.149.45.128"), F.lit("118.131.117.245"))) == 0.2158203125
    assert one(spark, MF.ip_similarity(F.lit("1.2.3.4"), F.lit("1.2.3.4"))) == 1.0


def test_ip_set_similarity_unbounded_and_normalized(spark):
    s = F.lit("10.0.0.1-10.0.0.2")
    assert one(spark, MF.ip_set_similarity(s, s)) == 1.9990234375
    assert one(spark, MF.ip_set_similarity(s, s, normalize=True)) == pytest.approx(1.9990234375 / 2)
    assert one(spark, MF.ip_set_similarity(F.lit("1.1.1.1-1.1.1.1"), F.lit("1.1.1.1"))) == 1.0


def test_utf8_bytes(spark):
    assert one(spark, MF.utf8_bytes(F.lit("hé"))) == [104, -61, -87]
    assert one(spark, MF.utf8_bytes(F.lit(""))) == []


def test_longer_shorter(spark):
    assert one(spark, MF.longer_term(F.lit("ab"), F.lit("cd"))) == "cd"
    assert one(spark, MF.shorter_term(F.lit("ab"), F.lit("cd"))) == "cd"
    assert one(spark, MF.longer_term(F.lit("abc"), F.lit("cd"))) == "abc"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert one(spark, MF.vec_add(a, b)) == [5.0, 8.0]
    assert one(spark, MF.vec_sub(a, b)) == [-3.0, -4.0]
    assert one(spark, MF.vec_div(a, 0.0)) == [None, None, None]
    assert one(spark, MF.dot(a, b)) == 16.0
    assert one(spark, MF.norm(b)) == math.sqrt(52.0)
    assert one(spark, MF.vec_max(a, b)) == [4.0, 6.0]
    assert one(spark, MF.euclidean_arr(a, b)) == 5.0
    assert one(spark, MF.manhattan_arr(a, b)) == 7.0
    assert one(spark, MF.cosine_arr(F.array(F.lit(0.0), F.lit(0.0)), b)) is None


def test_weighted_dot_reference_case(spark):
    """The reference test's intent: weights (1, 0) make (1,2)-(1,9) distance 0, (0, 1) not."""
    x, y = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(9.0))
    d = MF.vec_sub(x, y)
    assert one(spark, F.sqrt(MF.weighted_dot(d, F.array(F.lit(1.0), F.lit(0.0)), d))) == 0.0
    assert one(spark, F.sqrt(MF.weighted_dot(d, F.array(F.lit(0.0), F.lit(1.0)), d))) != 0.0


def test_points(spark):
    assert one(spark, MF.point_distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))) == 5.0
    assert one(spark, MF.render_point(F.lit(1.0), F.lit(2.5))) == "(1.00 - 2.50)"
    assert one(spark, MF.render_centroid_line(F.lit(1.25), F.lit(1.5))) == "1.250000\t1.500000"


def test_scale_interval_constant_column(spark):
    assert one(spark, MF.scale_interval(F.lit(5.0), 5.0, 5.0)) == 0.0
    assert one(spark, MF.scale_interval(F.lit(5.0), 10.0, 0.0)) == 0.5


def test_distance_registry():
    assert numeric_distance("euclidean") is not None
    assert string_distance("normalizedLevenshtein") is not None
    with pytest.raises(ValueError):
        numeric_distance("chebyshev")
    with pytest.raises(ValueError):
        string_distance("jaro")


def test_ip_similarity_of_short_and_malformed_addresses(spark):
    from mixclust.functions.ip import ip_similarity

    df = spark.createDataFrame([("1.2", "1.2.3.4"), ("_", "1.2.3.4"), ("1.2.", "1.3"), ("1.2.3.4", "1.2.3.4")], "a string, b string")
    assert [r[0] for r in df.select(ip_similarity("a", "b")).collect()] == [0.5, None, (1 + 1 - 1 / 256) / 4, 1.0]


def pair_by_pair(a, b):
    """P28 by its definition; None if a compared part is no number."""
    a, b = dict.fromkeys(a.split("-")), dict.fromkeys(b.split("-"))
    total = 0.0
    for x in a:
        for y in b:
            for p, q in zip(x.split("."), y.split(".")):
                if not (p.isdigit() and q.isdigit()):
                    return None
            for p, q in zip(x.split("."), y.split(".")):
                total += (1 - abs(int(p) - int(q)) / 256) / 4
                if p != q:
                    break
    return (total / len(a) + total / len(b)) / 2


def test_ip_sets_are_summed_as_pair_by_pair(spark):
    import random

    rng = random.Random(5)

    def address():
        parts = [str(rng.choice([1, 2, 3, 200, 255])) for _ in range(rng.choice([4, 4, 4, 4, 1, 2, 3, 5]))]
        if rng.random() < 0.01:
            parts[rng.randrange(len(parts))] = "x"
        return ".".join(parts)

    rows = [tuple("-".join(address() for _ in range(rng.randint(1, 40))) for _ in "ab") for _ in range(300)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", MF.ip_set_similarity("a", "b").alias("s")).collect()
    assert all(r.s == (None if (want := pair_by_pair(r.a, r.b)) is None else pytest.approx(want, abs=1e-12)) for r in got)
    assert 20 < sum(r.s is None for r in got) < 280
    assert one(spark, MF.ip_set_similarity(F.lit(None).cast("string"), F.lit("1.2.3.4"))) is None


def test_ip_sets_of_thousands_of_members(spark):
    import time

    big = [f"10.{i % 7}.{i // 7 % 256}.{i % 256}" for i in range(3000)]
    df = spark.createDataFrame([("-".join(big), "-".join(big[::-1]))], "a string, b string")
    began = time.perf_counter()
    got = df.select(MF.ip_set_similarity("a", "b")).first()[0]
    assert time.perf_counter() - began < 20  # 9 million pairs
    assert got == pytest.approx(pair_by_pair("-".join(big), "-".join(big)))


def test_ip_sets_with_odd_members(spark):
    """Signs, blanks, line breaks, long numbers, empty members and more than four parts; a NULL set beside others."""
    rows = [("1.2.3.4", "+1. 2.3.4 "), ("1.2.3..", "1.2.3"), ("1.2.\n", "1.2"), ("", "1.2"), ("1.2-", "1.2"), ("1.2.3.4.5", "1.2.3.4.7"),
            ("2147483647.1", "0.1"), ("2147483648.1", "0.1"), ("1.2.x", "1.2"), ("1.2.x", "1.2-1.2.3"), ("9.2.x", "1.2.3"), (".1", "1"), (None, "1.2"), ("1.2", None)]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(MF.ip_set_similarity("a", "b").alias("s")).collect()]
    assert got == [1.0, 0.75, 0.5, None, None, (4 + 1 - 2 / 256) / 4, (1 - 2147483647 / 256) / 4, None, 0.5, None, None, None, None, None]


def test_ip_sets_in_several_blocks(spark, monkeypatch):
    import pyarrow as pa

    from mixclust.functions import ip

    a = pa.array(["1.2.3.4-1.2.3.5", None, "9.9.9.9", "1.2.3.4"] * 5)
    b = pa.array(["1.2.3.4", "1.2", "9.9.9.9-9.9.9.8-9.9.9.8", "x"] * 5)
    whole = ip._set_sums(a, b).to_pylist()
    assert whole[:4] == [{"total": 2 - 1 / 1024, "one": 2, "other": 1}, dict.fromkeys(("total", "one", "other")),
                         {"total": 2 - 1 / 1024, "one": 1, "other": 2}, dict.fromkeys(("total", "one", "other"))]
    monkeypatch.setattr(ip, "BLOCK_BYTES", 20)
    assert ip._set_sums(a, b).to_pylist() == whole
    assert len(ip._set_sums(a.slice(0, 0), b.slice(0, 0))) == 0


def test_both_forms_of_ip_sets_cost_one_pass(spark):
    """No fold per member, and one call for both forms of the same two sets."""
    df = spark.createDataFrame([("1.2.3.4", "1.2.3.5")], "a string, b string").select(
        MF.ip_set_similarity("a", "b").alias("s"), MF.ip_set_similarity("a", "b", normalize=True).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    line = next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    assert line.count("_set_sums(") == 1


def test_ip_similarity_reads_each_address_once(spark):
    df = spark.createDataFrame([("1.2.3.4.5", "1.2.3.4.6"), ("1.2.3.4.x", "1.2.3.4.6"), ("1.2.3.4", "1.2.3.4.x"), (None, "1")], "a string, b string")
    out = df.select(MF.ip_similarity("a", "b").alias("s"))
    assert [r.s for r in out.collect()] == [(5 - 1 / 256) / 4, None, 1.0, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


@pytest.mark.parametrize("name", ["ip_set_similarity", "ip_similarity_edges"])
def test_ip_queries_use_all_cores_on_one_file(spark, tmp_path, name):
    import workloads

    keys = spark.range(0, 2000, 1, 1).selectExpr("id AS o_orderkey", "id % 77 AS o_custkey")
    keys.write.parquet(str(tmp_path / "orders.parquet"))
    got = workloads.QUERIES[name](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert got.count() == 2000


@pytest.mark.parametrize("k", [3, 40])
def test_assignment_by_ip_sets(spark, k):
    """Few centroids are literals; beyond MOST_LITERALS the Arrow function puts points beside centroids."""
    from mixclust.operators.assign import assign
    from mixclust.plans.geometry import Geometry
    from mixclust.plans.params import FeatureSpec

    ips = [f"10.{i % 7}.{i % 5}.{i}-10.{i % 3}.1.{i}" for i in range(60)]
    cents = [{"cluster_id": j, "s": f"10.{j % 7}.{j % 4}.{j}"} for j in range(k)]
    geom = Geometry((FeatureSpec("s", "categorical", ("s",), "ip"),), {"s": 1.0}, 1)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ips)], "id long, s string").repartition(2)
    got = {r.id: r for r in assign(df, cents, geom).collect()}
    for i, s in enumerate(ips):
        want = min((1 - pair_by_pair(s, c["s"]), -c["cluster_id"]) for c in cents)
        assert (got[i].cluster_id, got[i].distance) == (-want[1], pytest.approx(want[0]))
