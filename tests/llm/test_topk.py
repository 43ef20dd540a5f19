import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixclust.llm.queries import ORACLE_SQL, QUERIES
from mixclust.llm.topk import groups, products, top_k

SF = "/root/testdata/sf0.01"


def brute(rows, asked, k):
    """(query_id, rank, vec_id, score) of {id: vector}."""
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i] = min(fine.get(i, v), v)
    dims = max((len(v) for v in fine.values()), default=0)
    ints = {i: [math.floor(256 * x) for x in v] + [0] * (dims - len(v)) for i, v in fine.items()}
    out = []
    for q in ints:
        if asked(q):
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, dims))
    rows = [(int(i), [float(x) for x in np.float32(centres[rng.integers(6)] + rng.normal(0, 0.1, dims))]) for i in range(n)]
    same = rows[3][1]
    return rows + [(n + i, list(same)) for i in range(n // 3)]  # a third of all vectors are copies


@pytest.mark.parametrize("pivots,group,tile", [(None, 2048, 32_768), (5, 7, 50), (40, 3, 33), (1, 100, 1000)])
def test_against_brute_force(spark, pivots, group, tile):
    rows = vectors(240, 8, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = top_k(df, F.col("vec_id") % 4 == 0, 5, pivots, group, tile)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda q: q % 4 == 0, 5)


def test_bounds_leave_out_far_cells(spark):
    """Vectors that cannot matter are not sent: the join keeps fewer rows than the table has."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in (np.array([4.0, 0, 0]) if i < 20 else np.array([-4.0, 0, 0])) + rng.normal(0, 0.01, 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, top_k(df, F.col("vec_id") < 20, 3, pivots=12).collect()))
    assert got == brute(rows, lambda q: q < 20, 3)


def test_rough_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [None, 1.0]), (150, [nan, 1.0]), (200, [inf, 0.0]), (250, []), (300, [0.5]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]),
            (3, [-1.0, -1.0]), (3, [-2.0, 0.0]), (None, [9.0, 9.0]), (350, [1e-9, -1e-9]), (4, [3e6, 3e6]), (400, [5e6, -4e6])]
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    expected = brute(rows, lambda q: q % 50 == 0, 5)
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == expected
    assert top_k(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert top_k(df, F.col("vec_id") == 7).collect() == []
    few = df.where("vec_id IN (0, 1, 2)")
    assert sorted(map(tuple, top_k(few, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 1, 256 * 256 * 5), (0, 2, 2, 256 * 256 * 5)]


def test_exact_products_of_large_numbers():
    a, b = np.array([[3.0e8, 1.0]]), np.array([[3.0e8, 1.0]])
    assert products(a, b)[0, 0] == 9 * 10**16 + 1


def test_groups_hold_their_bound():
    rng = np.random.default_rng(0)
    pivots, queries = rng.normal(size=(30, 4)), rng.integers(0, 9, 30)
    queries[4] = 100
    first, parts = groups(pivots, queries, 10)
    for g in set(first):
        own = queries[first == g]
        assert own.sum() <= 10 or (len(own[own > 0]) == 1 and parts[(first == g) & (queries > 10)].max() >= 10)


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op10_top_k"](spark, SF).collect())) == brute(rows, lambda q: q % 50 == 0, 5)
    assert "op10_top_k" in ORACLE_SQL


def test_queries_go_to_reached_tiles_only(spark):
    """Two far lumps, each in tiles of its own: a group's block is in the tiles of its lump, and no row is a query times a tile."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (np.array([9.0, 0, 0]) if i % 2 else np.array([-9.0, 0, 0])) + rng.normal(0, 0.01, 3)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = top_k(df, F.col("vec_id") % 10 == 1, 3, pivots=8, tile=40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" not in plan and plan.count("FlatMapGroupsInArrow") >= 2
    assert sorted(map(tuple, out.collect())) == brute(rows, lambda q: q % 10 == 1, 3)
