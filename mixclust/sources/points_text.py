"""2-D point text scan (R2) and deterministic random points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines 'x y [...]' split on one space; columns after the second are ignored.
    Lines without two numbers go to the second DataFrame instead of failing the job."""
    parts = F.split(F.col("value"), " ")
    df = spark.read.text(path).select(
        "value",
        F.get(parts, 0).try_cast("double").alias("x"),
        F.get(parts, 1).try_cast("double").alias("y"))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    return df.where(ok).select("x", "y"), df.where(~ok).select("value")


def uniform_from_key(key: Column, stream: str, seed: int, scale: float = 10.0) -> Column:
    """A value in [0, scale) from md5(key, stream, seed): the same for a key wherever
    and however it is partitioned (Spark's rand() depends on the partitioning)."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{stream}:{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.lit(scale)


def random_points(keys: DataFrame, key: str, seed: int = 42, scale: float = 10.0) -> DataFrame:
    """One random point (x, y) in [0, scale)^2 per row of `keys`."""
    k = F.col(key)
    return keys.select(k.alias("key"), uniform_from_key(k, "x", seed, scale).alias("x"),
                       uniform_from_key(k, "y", seed, scale).alias("y"))
