"""Centroid updates: partial sums and means (A3, A4, A6), the byte-mean string (A8),
the categorical medoid over the first m points of a cluster (A7, T2, J6), the
keep-empty merge (J3) and the movement of each centroid (J5).

Every update ends in at most k rows; only cluster-level partial aggregates shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.geometry import Geometry, cols


def cluster_sums(assigned: DataFrame, numeric_columns: Sequence[str], group_terms: Sequence[str] = ()) -> DataFrame:
    """Per (cluster_id, *group_terms): __n and __s_<c> sums. Partial aggregation runs
    before the shuffle, so a cluster holding a third of the data costs one row per task."""
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.sum(c).alias(f"__s_{c}") for c in numeric_columns]
    return assigned.groupBy("cluster_id", *group_terms).agg(*aggs)


def mean_centroids(sums: DataFrame, numeric_columns: Sequence[str]) -> DataFrame:
    """cluster_id, n, <c> = sum / n (from the output of cluster_sums)."""
    agg = sums.groupBy("cluster_id").agg(
        F.sum("__n").alias("n"), *[F.sum(f"__s_{c}").alias(f"__s_{c}") for c in numeric_columns])
    return agg.select("cluster_id", "n", *[(F.col(f"__s_{c}") / F.col("n")).alias(c) for c in numeric_columns])


def _signed_byte_prefix(term: Column, length: Column) -> Column:
    """The first `length` UTF-8 bytes of a string as signed ints."""
    h = F.hex(F.encode(term, "UTF-8"))
    raw = F.transform(F.sequence(F.lit(0), length - 1),
                      lambda i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("int"))
    return F.transform(raw, lambda b: F.when(b >= 128, b - 256).otherwise(b))


def byte_means(term_counts: DataFrame, column: str, count_col: str = "__n", limits: DataFrame | None = None) -> DataFrame:
    """A8 per cluster: byte-wise sum of all its terms, cut to the shortest term, integer
    division by the cluster size (truncating toward zero, as JVM ints), back to a UTF-8
    string with invalid sequences replaced.

    Input: cluster_id, <column>, <count_col> (points that the row stands for; a (cluster, term) pair
    may have several rows). `limits`: cluster_id, __L (bytes of the shortest term), __N (points), if
    known. They have a row per cluster and are broadcast; the bytes are summed map-side, so the shuffle
    takes a row per cluster, position and task, and no row is keyed by its term.
    """
    t = term_counts.select("cluster_id", column, F.col(count_col).alias("__c"))
    lim = limits if limits is not None else t.groupBy("cluster_id").agg(
        F.min(F.octet_length(column)).alias("__L"), F.sum("__c").alias("__N"))
    exploded = (
        t.join(F.broadcast(lim), "cluster_id")
        .where(F.col("__L") > 0)
        .select("cluster_id", "__N", "__c",
                F.posexplode(_signed_byte_prefix(F.col(column), F.col("__L"))).alias("__pos", "__b"))
    )
    per_pos = exploded.groupBy("cluster_id", "__pos").agg(
        F.sum(F.col("__b").cast("bigint") * F.col("__c")).alias("__s"), F.max("__N").alias("__N"))
    per_pos = per_pos.select(
        "cluster_id", "__pos",
        F.lpad(F.hex(F.expr("(__s div __N) & 255")), 2, "0").alias("__h"))
    rebuilt = per_pos.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("__pos", "__h"))).alias("__bytes"))
    text = F.make_valid_utf8(F.unhex(F.concat_ws("", F.transform("__bytes", lambda x: x["__h"]))).cast("string"))
    rebuilt = rebuilt.select("cluster_id", text.alias(column))
    return lim.select("cluster_id").join(rebuilt, "cluster_id", "left").select(
        "cluster_id", F.coalesce(F.col(column), F.lit("")).alias(column))


def first_m_per_cluster(assigned: DataFrame, m: int, order_cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first m points of every cluster in `order_cols` order, numbered __rn.
    `row_number() <= m` plans a WindowGroupLimit, so each task ships at most m rows per
    cluster to the shuffle however large the cluster is."""
    w = Window.partitionBy("cluster_id").orderBy(*order_cols)
    wanted = list(dict.fromkeys(["cluster_id", *order_cols, *keep]))
    return assigned.select(*wanted).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= m)


def medoids(assigned: DataFrame, geom: Geometry, m: int, order_cols: Sequence[str]) -> DataFrame:
    """Per cluster and categorical feature, the sampled term with the least mean
    distance to the sample; equal means (rounded to 12 digits) go to the later sample."""
    return medoids_of(first_m_per_cluster(assigned, m, order_cols, geom.categorical_columns), geom)


def medoids_of(sample: DataFrame, geom: Geometry) -> DataFrame:
    """A7 on a sample that is already there: cluster_id, __rn (from 1) and the terms of each point."""
    out: DataFrame | None = None
    for f in geom.categoricals:
        a = sample.select("cluster_id", F.col("__rn").alias("__arn"), F.col(f.column).alias("__a"))
        b = sample.select("cluster_id", F.col(f.column).alias("__b"))
        d = geom.feature_distance(f, lambda _n: F.col("__b"), lambda _n: F.col("__a"))
        means = a.join(b, "cluster_id").groupBy("cluster_id", "__arn", "__a").agg(F.avg(d).alias("__m"))
        best = means.groupBy("cluster_id").agg(
            F.min(F.struct(F.round("__m", 12).alias("m"), (-F.col("__arn")).alias("o"), F.col("__a").alias("t")))
            .alias("__best"))
        best = best.select("cluster_id", F.col("__best.t").alias(f.column))
        out = best if out is None else out.join(best, "cluster_id")
    return out


def centroid_schema(geom: Geometry) -> T.StructType:
    fields = [T.StructField("cluster_id", T.IntegerType(), False)]
    fields += [T.StructField(c, T.DoubleType(), True) for c in geom.numeric_columns]
    fields += [T.StructField(c, T.StringType(), True) for c in geom.categorical_columns]
    return T.StructType(fields)


def centroids_frame(spark: SparkSession, centroids: list[dict], geom: Geometry, prefix: str = "") -> DataFrame:
    """k driver rows as a DataFrame (the only data that ever crosses the driver)."""
    schema = centroid_schema(geom)
    names = [f.name for f in schema.fields]
    rows = [tuple(c.get(n) for n in names) for c in centroids]
    df = spark.createDataFrame(rows, schema)
    if prefix:
        df = df.select("cluster_id", *[F.col(n).alias(prefix + n) for n in names[1:]])
    return df


def with_movement(new: DataFrame, old: DataFrame, geom: Geometry) -> DataFrame:
    """Distance between each new centroid and the old one of the same cluster_id
    (`old` carries columns prefixed 'o_')."""
    joined = new.join(F.broadcast(old), "cluster_id", "left")
    return joined.withColumn("movement", geom.distance(cols(), cols("o_"))).drop(
        *[c for c in old.columns if c != "cluster_id"])


def keep_empty(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A cluster that got no point keeps its old centroid (`old` has 'o_' columns)."""
    joined = old.join(new, "cluster_id", "left")
    return joined.select("cluster_id", *[F.coalesce(F.col(c), F.col("o_" + c)).alias(c) for c in columns],
                         *[F.col("o_" + c) for c in columns])
