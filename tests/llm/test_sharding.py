import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mixclust.llm.queries import QUERIES
from mixclust.llm.sharding import scattered, write_shards
from mixclust.session import fresh_dir

from .conftest import SF


def check(rows, docs, shards):
    """The law `rows`: every record once, counts at most one apart, slots without gaps."""
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs)
    slots = {k: sorted(r.slot for r in rows if r.shard == k) for k in range(shards)}
    assert all(s == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("shards,bucket_bytes", [(8, 1 << 25), (8, 2000), (3, 500), (40, 100)])
def test_records_shards_and_slots(spark, rough, shards, bucket_bytes):
    docs = rough.where("doc_id IS NULL OR doc_id NOT IN (11, 12, 16)") if bucket_bytes < 1000 else rough
    path = fresh_dir(spark, "shards")
    check(write_shards(docs, path, shards, bucket_bytes=bucket_bytes).collect(), docs.collect(), shards)
    assert spark.read.parquet(path).count() == docs.count()


def test_repeatable_seeded_and_mixed(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    order = lambda df, **k: [r.doc_id for r in write_shards(df, fresh_dir(spark, "shards"), 4, bucket_bytes=4000, **k).orderBy("shard", "slot").collect()]
    one = order(docs)
    assert one == order(docs.repartition(7)) != order(docs, seed=7)
    third = len(one) // 3
    assert abs(sum(one[:third]) / third - 1499.5) < 120  # ids are spread evenly


def test_repeated_records_are_dealt_to_all_buckets(spark):
    """A third of the rows are one record, a sixth others of null id and one text."""
    docs = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 6 = 1 THEN NULL ELSE id END AS doc_id",
        "CASE WHEN id % 3 = 0 THEN repeat('copy ', 20) WHEN id % 6 = 1 THEN 'same' ELSE concat('text ', id, repeat(' x', 40)) END AS text")
    rows = scattered(docs.select("doc_id", "text"), 16, 42, 32_000)
    sizes = [r.n for r in rows.groupBy("bucket").agg(F.sum("copies").alias("n")).collect()]
    assert sum(sizes) == 6000 and len(sizes) == 16 and max(sizes) < 2 * min(sizes)
    assert rows.where("doc_id = 7").count() == 16 and rows.where("doc_id IS NULL").count() == 16  # no row for each copy
    one = write_shards(docs, fresh_dir(spark, "shards"), 8, bucket_bytes=32_000).collect()
    check(one, docs.collect(), 8)
    two = write_shards(docs.repartition(5), fresh_dir(spark, "shards"), 8, bucket_bytes=32_000).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_empty_and_reserved_names(spark, none, rough):
    assert write_shards(none, fresh_dir(spark, "shards")).collect() == []
    with pytest.raises(ValueError):
        write_shards(rough, fresh_dir(spark, "shards"), carry=("doc_id", "text", "slot"))


def test_query(spark):
    rows = QUERIES["op6_sharding"](spark, SF).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
