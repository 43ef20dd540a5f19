"""Plans for many centroids: the same answers, few exact evaluations, any kind of distance."""
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixclust.functions import distances as D
from mixclust.operators import assign as A
from mixclust.operators import pruned
from mixclust.operators.assign import assign, search_parts
from mixclust.plans.geometry import NUMERIC_RESCALE, Geometry
from mixclust.plans.params import FeatureSpec, categorical, numeric


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(rng, n, longest=12, letters="abcdé漢😀"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_edit_distances_and_their_bounds():
    rng = random.Random(1)
    a = words(rng, 40) + ["", "x" * 64, "y" * 65, "ab" * 70, "é" * 64]
    b = words(rng, 30) + ["", "x" * 63 + "z", "ab" * 69 + "c", "x" * 100, "q" * 64]
    x, y = pruned.Terms(a), pruned.Terms(b)
    i, j = (m.ravel() for m in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    expected = np.array([edit_distance(a[p], b[q]) for p, q in zip(i, j)])
    assert (pruned.edits(x, y, i, j) == expected).all()
    least = pruned.least_edits(x, y)[i, j]
    assert (least <= expected).all() and (least >= np.abs(x.length[i] - y.length[j])).all()


def spaces(rng, n, k):
    terms = words(rng, 60, 9, "abcdef")
    row = lambda: (rng.random(), rng.choice((rng.random(), 0.5)), rng.choice(terms), rng.choice(terms[:9]))
    points = [(i, *row()) for i in range(n)] + [(n, None, 0.5, "a", "b"), (n + 1, 0.5, 0.5, None, "b"), (n + 2, float("nan"), 0.1, "", "")]
    cents = [dict(zip(("cluster_id", "x", "y", "s", "t"), (i, *row()))) for i in range(k)]
    cents[3] = dict(cents[1], cluster_id=3)  # equal seeds: the later one wins
    cents[5]["s"] = None
    return points, cents


FEATURES = (numeric("place", "x", "y"), categorical("s", "s"), FeatureSpec("t", "categorical", ("t",), "levenshtein"))
WEIGHTS = {"place": 0.4, "s": 0.4, "t": 0.2}


@pytest.mark.parametrize("distance", ["euclidean", "manhattan", "cosine"])
def test_same_answers_as_the_column_plan(spark, distance, monkeypatch):
    rng = random.Random(2)
    points, cents = spaces(rng, 400, 90)
    df = spark.createDataFrame(points, "id long, x double, y double, s string, t string").repartition(3)
    geom = Geometry((numeric("place", "x", "y", distance=distance), *FEATURES[1:]), WEIGHTS, 1)
    got = sorted(assign(df, cents, geom).collect(), key=lambda r: r.id)
    monkeypatch.setattr(A, "search_parts", lambda _g: None)
    expected = sorted(assign(df, cents, geom).collect(), key=lambda r: r.id)
    assert [(r.id, r.cluster_id, r.distance) for r in got] == [(r.id, r.cluster_id, r.distance) for r in expected]
    assert got[400].cluster_id is None and got[401].distance is None and 1 not in {r.cluster_id for r in got}
    assert got[0].asDict().keys() == expected[0].asDict().keys()


def test_few_candidates_are_evaluated():
    rng = random.Random(3)
    points, cents = spaces(rng, 3000, 300)
    geom = Geometry(FEATURES, WEIGHTS, 1)
    search = pruned.Search(cents, search_parts(geom), NUMERIC_RESCALE)
    block = pa.RecordBatch.from_arrays([pa.array(c) for c in list(zip(*points))[1:]], names=["x", "y", "s", "t"])
    who, d = search.nearest(block)
    assert search.evaluations < 0.1 * len(points) * len(cents)
    assert np.isnan(d[-3:]).all() and not np.isnan(d[:-3]).any() and set(who[:-3]) <= {c["cluster_id"] for c in cents}


def test_no_column_of_a_point_is_lost(spark):
    rng = random.Random(4)
    points, cents = spaces(rng, 30, 40)
    df = spark.createDataFrame([(*p, ["z"], {"k": 1}, None) for p in points], "id long, x double, y double, s string, t string, tags array<string>, m map<string,int>, cluster_id string")
    out = assign(df, cents, Geometry(FEATURES, WEIGHTS, 1), distance_col=None)
    assert out.columns == ["id", "x", "y", "s", "t", "tags", "m", "cluster_id"] and out.count() == 33
    assert out.where("id = 7").first().m == {"k": 1} and out.where("false").count() == 0
    assert assign(df.where("false"), cents, Geometry(FEATURES, WEIGHTS, 1)).collect() == []


@pytest.mark.parametrize("k", [5, 33, 300])
def test_python_distances_at_any_k(spark, k):
    @F.pandas_udf("double")
    def prefix_distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else 1.0 / (1 + sum(p == q for p, q in zip(x, y))) for x, y in zip(a, b)])

    D.register_distance("categorical", "prefix", prefix_distance)
    try:
        rng = random.Random(5)
        points, cents = spaces(rng, 60, max(k, 6))
        cents = cents[:k]
        for c in cents:
            c["s"] = c["s"] or "a"
        geom = Geometry((numeric("place", "x", "y"), FeatureSpec("s", "categorical", ("s",), "prefix")), {"place": 0.5, "s": 0.5}, 1)
        df = spark.createDataFrame(points, "id long, x double, y double, s string, t string").repartition(2)
        got = {r.id: r for r in assign(df, cents, geom).collect()}
        assert len(got) == len(points)
        for i, x, y, s, t in points:
            if x is None or s is None or x != x:
                assert got[i].cluster_id is None and got[i].distance is None
                continue
            d = [((0.5 * (np.sqrt((x - c["x"]) ** 2 + (y - c["y"]) ** 2) / NUMERIC_RESCALE) + 0.5 / (1 + sum(p == q for p, q in zip(s, c["s"])))) / 2, -c["cluster_id"]) for c in cents]
            assert got[i].cluster_id == -min(d, key=lambda v: (round(v[0], 12), v[1]))[1] and got[i].distance == pytest.approx(min(d)[0])
    finally:
        D.STRING_DISTANCES.pop("prefix")
