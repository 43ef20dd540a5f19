"""The SQL of the subpackage's queries against the queries, on the smallest tables."""

import duckdb
import pytest

from mixclust.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op4_near_dedup", "op13_jaccard_join"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    rel = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())
