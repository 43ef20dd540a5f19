"""Cluster-quality evaluation (K7): size and mean radius per cluster (A9, A10), intra
average distance (A11), inter average distance over centroid pairs (A12, J4), totals (A13).

The points are reassigned to the final centroids; only k rows of per-cluster partial
sums are shuffled. The centroid pair join works on the k centroid rows alone, in triangular tiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.geometry import Geometry, cols
from .assign import TermDictionary, assign
from .update import centroids_frame

TILE = 512
MOST_PARTITIONS = 10_000  # of the pair join: beyond, a partition takes several pairs of tiles


def cluster_stats(points: DataFrame, centroids: list[dict], geom: Geometry,
                  dictionaries: dict[str, TermDictionary] | None = None) -> DataFrame:
    """cluster_id, n, radius (mean distance point -> its nearest final centroid)."""
    assigned = assign(points, centroids, geom, dictionaries, distance_col="distance").where("cluster_id IS NOT NULL")
    return assigned.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("distance").alias("radius"))


def centroid_pairs(centroids: DataFrame, geom: Geometry, tile: int = TILE) -> DataFrame:
    """Every pair i < j of the k centroids with its distance.

    The centroids are cut into tiles of ``tile`` consecutive ids. A pair of tiles (the first not after the second) is
    one key of an equi-join and of one partition, so pairs are formed tile by tile over all tasks and no task holds all
    centroids; each centroid is sent to k / tile places."""
    last = centroids.agg(F.max("cluster_id")).first()[0]  # one number
    tiles = (last or 0) // tile + 1
    own = F.floor(F.col("cluster_id") / tile).cast("int")
    values = [c for c in centroids.columns if c != "cluster_id"]
    a = centroids.select(F.explode(F.sequence(own, F.lit(tiles - 1))).alias("__t"), own.alias("__s"), "cluster_id",
                         *[F.col(c).alias("a_" + c) for c in values])
    b = centroids.select(F.explode(F.sequence(F.lit(0), own)).alias("__s"), own.alias("__t"), F.col("cluster_id").alias("b_cluster_id"),
                         *[F.col(c).alias("b_" + c) for c in values])
    if tiles > 1:  # a stated number of partitions: few bytes here make much work, which sizes would not show
        n = min(tiles * (tiles + 1) // 2, MOST_PARTITIONS)
        a, b = a.repartition(n, "__s", "__t"), b.repartition(n, "__s", "__t").hint("shuffle_hash")
    pairs = a.join(b, ["__s", "__t"]).where(F.col("cluster_id") < F.col("b_cluster_id"))
    return pairs.select(F.col("cluster_id").alias("cluster_a"), F.col("b_cluster_id").alias("cluster_b"),
                        geom.distance(cols("a_"), cols("b_")).alias("distance"))


def inter_distance(centroids: DataFrame, geom: Geometry) -> DataFrame:
    """Unweighted mean over the centroid pairs (NULL for a single centroid)."""
    return centroid_pairs(centroids, geom).agg(F.avg("distance").alias("inter_avg_distance"))


@dataclass
class Quality:
    quality: DataFrame        # 1 row
    stats: DataFrame          # one row per non-empty cluster


def evaluate(points: DataFrame, centroids: list[dict], geom: Geometry, iterations: int,
             dictionaries: dict[str, TermDictionary] | None = None) -> Quality:
    """One pass over the points gives the k rows of statistics; the quality row is derived from
    them and from the centroid pairs. Points without a nearest centroid count nowhere."""
    spark = points.sparkSession
    found = cluster_stats(points, centroids, geom, dictionaries)
    stats = spark.createDataFrame(found.collect(), found.schema)  # k rows
    cents = centroids_frame(spark, centroids, geom)
    inter = inter_distance(cents, geom)
    totals = stats.agg(
        F.sum("n").alias("num_points"),
        (F.sum(F.col("radius") * F.col("n")) / F.sum("n")).alias("intra_avg_distance"))
    # two one-row results side by side: stack them and fold with max (no join needed)
    both = totals.unionByName(inter, allowMissingColumns=True).agg(
        F.max("num_points").alias("num_points"), F.max("intra_avg_distance").alias("intra_avg_distance"),
        F.max("inter_avg_distance").alias("inter_avg_distance"))
    quality = both.select(
        F.lit(len(centroids)).cast("int").alias("num_centroids"),
        F.col("num_points").cast("bigint").alias("num_points"),
        F.lit(int(iterations)).cast("int").alias("num_iterations"),
        "inter_avg_distance", "intra_avg_distance")
    return Quality(quality, stats)
