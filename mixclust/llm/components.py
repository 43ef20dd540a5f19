"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.session import written


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, component): for each id in ``links`` the smallest id it is linked with, over any number of steps.

    Each step writes its table to the shared folder; the steps needed grow with the logarithm of the
    largest component. Links of an id with itself are allowed, and keep it in the result."""
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct(), "links")
    before = None
    for _ in range(most):
        # large star: of each id's larger neighbours, link all with its smallest neighbour
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # small star: of each id's smaller neighbours, link all, and the id, with the smallest
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        own = edges.where("u = v")
        edges = written(small.select("x.u", "x.v").where("u <> v").union(own).distinct(), "links")
        now = tuple(edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {most} steps")
    ids = edges.union(edges.select(F.col("v").alias("u"), "v"))
    return ids.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
