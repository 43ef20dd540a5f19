"""A quick run of registered queries against their DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF

FAST = ["coord_limits", "json_featurize", "ip_set_similarity", "vec_algebra", "lev_norm", "element_distance",
        "seed_sample", "assign_nearest", "kmeans_partialsums", "kmeans_standard", "kmeans2d_local_init",
        "cluster_quality", "random_points", "points_text_scan"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["part", "orders", "lineitem", "events", "embeddings"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    got = sorted(repr(tuple(norm(x) for x in r)) for r in df.collect())
    want = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rel.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["cluster_id", "n", "radius"]
    assert sum(r.n for r in df.collect()) == 200
