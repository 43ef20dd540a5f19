"""Sharding by a two-pass external shuffle.

Pass one scatters the records into memory-sized buckets by a seeded hash of what is carried. Equal records that
would fill a good part of a bucket are counted before anything moves, and their copies are dealt evenly over all buckets, as a row
and a number for each bucket. Pass two
puts each bucket into a fixed order, shuffles it (Fisher-Yates, seeded by seed and bucket) and writes
it. The law is ``rows``: the shuffled records, bucket after bucket, are cut into equal runs, so the
shards' counts differ by one at most and a bucket goes to one or two shards. Only counts per bucket
(one row for each ``bucket_bytes`` of input) are gathered; a lost task repeats its buckets exactly.

Defined cases: null text has size 1 and the checksum of the empty text; null or repeated ids and equal
texts are records as any other; fewer records than shards leave shards empty; an empty table gives an
empty result. Only the columns ``carry`` are written; of further columns none is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixclust.session import fresh_dir, written

BUCKET_BYTES = 32 << 20
SEED = 42


def size_of(text: str = "text") -> F.Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def bounds(n: int, shards: int) -> np.ndarray:
    """Where each shard begins in the shuffled sequence of n records, and n."""
    return np.arange(shards + 1, dtype=np.int64) * n // shards


def scattered(rows: DataFrame, n_buckets: int, seed: int, bucket_bytes: int) -> DataFrame:
    """``rows`` with bucket and copies (how many such records the row stands for). Only records whose copies come to an
    eighth of a bucket are looked up, of which there are at most eight a bucket; the others are rows as they are."""
    carry, key = rows.columns, F.xxhash64(F.lit(seed), *rows.columns)
    bulk = F.col("n") * (F.col("size") + 64) * 8 >= bucket_bytes
    repeated = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max(size_of()).alias("size"))
    repeated = written(repeated.where((F.col("n") > 1) & bulk).select("key"), "repeated-records")  # written: its size is known
    keyed, buckets = rows.withColumn("key", key), F.lit(n_buckets).cast("long")
    single = keyed.join(repeated, "key", "left_anti").select(*carry, F.pmod("key", buckets).cast("int").alias("bucket"), F.lit(1).cast("long").alias("copies"))
    counted = keyed.join(repeated, "key", "left_semi").groupBy(*carry, "key").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", buckets) - 1)))
    copies = F.floor(F.col("n") / buckets) + (F.col("at") < F.col("n") % buckets).cast("long")
    return single.union(dealt.select(*carry, F.pmod(F.pmod("key", buckets) + F.col("at"), buckets).cast("int"), copies.cast("long")))


def _shuffled(names: list[str], n: int, shards: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    edges = bounds(n, shards)

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in names]))
        rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), rows["copies"].to_numpy())))
        bucket, first = rows["bucket"][0].as_py(), rows["first"][0].as_py()
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(rows.num_rows)  # a Fisher-Yates shuffle
        at = first + np.arange(rows.num_rows, dtype=np.int64)
        shard = np.searchsorted(edges, at, "right") - 1
        return rows.select(names).take(pa.array(order)).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(at - edges[shard], pa.int64()))

    return one


def write_shards(docs: DataFrame, path: str, shards: int = 8, carry: tuple[str, ...] = ("doc_id", "text"), seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` as Parquet below ``path`` (shard=0 ...), and return that table: the columns ``carry``
    (doc_id and text at least), shard and slot (the place in the shard, from 0)."""
    if {"shard", "slot", "bucket", "first", "copies", "key"} & set(carry):
        raise ValueError("shard, slot, bucket, first, copies and key are names of the result or of steps to it")
    rows = docs.select(*carry)
    total = rows.agg(F.sum(size_of()).alias("size"), F.count(F.lit(1)).alias("n")).first()
    n_buckets = max(1, math.ceil((total["size"] or 0) / bucket_bytes))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = scattered(rows, n_buckets, seed, bucket_bytes)
    counts = rows.groupBy("bucket").agg(F.sum("copies").alias("n"))
    first = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("first"))
    out = rows.join(first, "bucket").groupBy("bucket").applyInArrow(_shuffled(list(carry), total["n"], shards, seed), f"{kinds}, shard int, slot long")
    out.write.partitionBy("shard").parquet(path)
    spark = docs.sparkSession
    return spark.read.schema(out.schema).parquet(path)


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard ``docs`` into the shared folder, and describe each written record: doc_id, size, text_crc32, law,
    shard, slot, grown_shard (null: the law is ``rows``)."""
    rows = write_shards(docs, fresh_dir(docs.sparkSession, "shards"), shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", size_of().alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
