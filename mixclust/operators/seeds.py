"""Seeding (T1) and the heuristic k (T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seed_order(id_col: str, seed: int):
    """A hash order of the ids: the same in any engine that has md5, and independent
    of how the data is partitioned."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def sample_seeds(points: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Exactly min(k, n) distinct points, numbered cluster_id 0..k-1 in hash order.

    `orderBy(...).limit(k)` plans as TakeOrderedAndProject: every task keeps its own k
    best rows and only those are merged, so no full sort of the data happens. Rows of one
    id follow a hash of all columns, then the columns, so the order is total.
    """
    rest = [c for c in points.columns if c != id_col]
    top = points.withColumn("__h", seed_order(id_col, seed)).withColumn("__t", F.xxhash64(*points.columns))
    order = ["__h", id_col, "__t", *rest]
    top = top.orderBy(*order).limit(k)
    w = Window.orderBy(*order)  # over k rows only
    return top.withColumn("cluster_id", (F.row_number().over(w) - 1).cast("int")).drop("__h", "__t")


def suggest_k(points: DataFrame) -> DataFrame:
    """n and k = floor(sqrt(n / 2)), at least 1."""
    n = points.agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.greatest(F.floor(F.sqrt(F.col("n") / 2.0)), F.lit(1)).cast("bigint").alias("k"))
