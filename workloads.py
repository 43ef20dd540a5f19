"""Registered queries: each runs one operator family of the library over the driver's
tables (whole tables, no row caps) and returns a DataFrame whose columns are named as in
the matching oracle SQL (`oracles.py`)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import mixclust.functions as MF
from mixclust.functions.distances import register_distance
from mixclust.operators.assign import assign, assign_2d
from mixclust.operators.evaluate import centroid_pairs, cluster_stats, evaluate, inter_distance
from mixclust.operators.featurize import featurize_spam, featurize_spam_reduced, split_valid
from mixclust.operators.scaling import coord_limits, fetch_limits, minmax_scale, unscale
from mixclust.operators.seeds import sample_seeds, suggest_k
from mixclust.operators.update import centroids_frame
from mixclust.plans.geometry import Geometry, cols
from mixclust.plans.job import run_job, run_job_on
from mixclust.plans.kmeans import kmeans_2d, kmeans_2d_cells, kmeans_mixed, local_init
from mixclust.plans.params import SPAM_FEATURES, ClusterParams, FeatureSpec, categorical, numeric
from mixclust.session import fresh_dir, spread
from mixclust.sources.json_lines import CORRUPT, SPAM_SCHEMA, read_json_lines
from mixclust.sources.points_text import random_points, read_points_text
from mixclust.sources.runlog import JOB_LINE, compare_runs, read_run_logs, trial_totals

Query = Callable[[SparkSession, str], DataFrame]

# --- shared settings of the workloads (also used by oracles.py) -------------------------
PART_FEATURES = (
    numeric("size", "p_size"),
    numeric("price", "p_retailprice"),
    categorical("type", "p_type"),
    categorical("name", "p_name"),
)
PART_WEIGHTS = {"size": 0.3, "price": 0.3, "type": 0.2, "name": 0.2}
PART_K = 8
ORDERS_FEATURES = (numeric("price", "o_totalprice"), numeric("cust", "o_custkey"))
ORDERS_WEIGHTS = {"price": 0.5, "cust": 0.5}
LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITERATIONS = 3
IP_STRETCH = 400
INIT_2D = [(0.1, 0.1), (0.5, 0.5), (0.9, 0.9)]
LOCAL_INIT_POSITIONS = (0, 2, 6)
MANY_K = 300
CUSTOM_K = 40
HICARD_FEATURES = (numeric("price", "o_totalprice"), categorical("tag", "tag"))
HICARD_WEIGHTS = {"price": 0.5, "tag": 0.5}
CONVERGE_EPSILON = 0.01
JOB_K, JOB_ITERATIONS = 8, 2
JOB_WEIGHTS = {"space": 0.2, "time": 0.1, "size": 0.1, "IP": 0.2, "uri": 0.2, "botname": 0.2}
R = 6  # digits kept in double outputs


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rnd(c, digits: int = R):
    return F.round(c if not isinstance(c, str) else F.col(c), digits)


# --- element sets ------------------------------------------------------------------------

def part_elements(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice", "p_type", "p_name")


def part_points(spark, d) -> tuple[DataFrame, dict]:
    el = part_elements(spark, d)
    lim = fetch_limits(el, ["p_size", "p_retailprice"])
    return minmax_scale(el, lim), lim


def part_geometry(m: int) -> Geometry:
    return Geometry(PART_FEATURES, PART_WEIGHTS, m)


def part_seeds(points: DataFrame, k: int = PART_K) -> list[dict]:
    rows = [r.asDict() for r in sample_seeds(points, k).collect()]
    for r in rows:
        r.pop("id")
    return rows


def orders_points(spark, d) -> DataFrame:
    el = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return minmax_scale(el, fetch_limits(el, ["o_totalprice", "o_custkey"]))


def line_points_2d(spark, d) -> DataFrame:
    el = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return minmax_scale(el, fetch_limits(el, ["x", "y"]))


def centroid_output(spark, centroids: list[dict], geom: Geometry) -> DataFrame:
    df = centroids_frame(spark, centroids, geom)
    return df.select("cluster_id", *[rnd(c).alias(c) for c in geom.numeric_columns], *geom.categorical_columns)


# --- scaling (A1, K1, K2, P9, P10) ---------------------------------------------------------

def q_coord_limits(spark, d):
    lim = coord_limits(table(spark, d, "lineitem"), LINE_COLS)
    return lim.select(*[(F.col(c) + 0.0).alias(c) for c in lim.columns])  # -0.0 and 0.0 print alike


def q_minmax_scale(spark, d):
    li = table(spark, d, "lineitem")
    sc = minmax_scale(li, fetch_limits(li, LINE_COLS))
    return sc.select("l_orderkey", "l_linenumber", *[rnd(c, 9).alias(c) for c in LINE_COLS])


def q_unscale_roundtrip(spark, d):
    li = table(spark, d, "lineitem")
    lim = fetch_limits(li, LINE_COLS)
    back = unscale(minmax_scale(li, lim), lim)
    return back.select("l_orderkey", "l_linenumber", *[rnd(c).alias(c) for c in LINE_COLS])


# --- JSON scan and featurizer (R1, P1-P5) --------------------------------------------------

def epoch_ms():
    """Epoch millis of a timestamp_ntz, independent of the session time zone."""
    return F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def events_json(spark, d, faults: bool = False) -> DataFrame:
    """Spam-like JSON records built from `events`: nulls are omitted by to_json, so the
    featurizer meets missing keys, empty strings, empty arrays and commas in URIs. With faults
    there are also blank and malformed lines, numbers that are not finite, and empty addresses."""
    ev = table(spark, d, "events")
    eid = F.col("event_id")
    ip = F.concat_ws(".", *[(F.col(c) % 256).cast("string") for c in ("user_id", "event_id")],
                     (F.floor(F.col("event_id") / 256) % 256).cast("string"), F.lit("7"))
    size = F.when(eid % 7 != 0, F.col("value").cast("string"))
    if faults:
        size = F.when(eid % 23 == 2, F.lit("NaN")).when(eid % 29 == 3, F.lit("Infinity")).otherwise(size)
    empty_ip = (eid % 31 == 4) & F.lit(faults)
    rec = F.struct(
        F.create_map(F.lit("$oid"), F.col("event_id").cast("string")).alias("_id"),
        F.create_map(F.lit("$date"), epoch_ms()).alias("date"),
        size.alias("size"),
        F.col("user_id").alias("long"),
        F.when(F.col("event_id") % 11 != 0, F.col("value") * 2).alias("lat"),
        F.when(empty_ip, F.lit("")).when(eid % 13 != 0, ip).alias("IP"),
        F.when(F.col("event_type") == "error", F.lit("")).when(F.col("event_type") != "view", F.col("event_type")).alias("bot"),
        F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>"))
         .when(F.col("event_id") % 5 != 1, F.array(F.concat(F.lit("http://h"), F.col("user_id").cast("string"), F.lit(".example/a,b")),
                                                   F.lit("http://second")))
         .alias("uri"),
    )
    line = F.to_json(rec)
    if faults:
        line = F.when(eid % 34 == 0, F.lit("")).when(eid % 17 == 0, F.lit("   ")) \
            .when(eid % 19 == 1, F.concat(F.lit("not json "), eid.cast("string"))).otherwise(line)
    return ev.select(line.alias("value"))


def events_lines(spark, d, faults: bool) -> str:
    """The records as a folder of JSON lines below the shared folder."""
    path = fresh_dir(spark, "json-lines")
    events_json(spark, d, faults).write.text(path)
    return path


SPAM_NUMBERS = [c for f in SPAM_FEATURES if f.kind == "numeric" for c in f.columns]


def q_json_lines_scan(spark, d):
    records, _ = read_json_lines(spark, events_lines(spark, d, True))
    return split_valid(featurize_spam(records), SPAM_NUMBERS)[0]


def q_json_rejects(spark, d):
    """Malformed lines as they are, and the ids of records whose numbers are not finite."""
    records, bad = read_json_lines(spark, events_lines(spark, d, True))
    values = split_valid(featurize_spam(records), SPAM_NUMBERS)[1]
    return bad.select(F.lit("line").alias("kind"), F.col(CORRUPT).alias("text")).unionByName(
        values.select(F.lit("values").alias("kind"), F.col("id").alias("text")))


def q_json_featurize(spark, d):
    parsed = events_json(spark, d).select(F.from_json("value", SPAM_SCHEMA).alias("r"))
    return featurize_spam(parsed, prefix="r.")


def q_json_featurize_reduced(spark, d):
    parsed = events_json(spark, d).select(F.from_json("value", SPAM_SCHEMA).alias("r"))
    return featurize_spam_reduced(parsed, prefix="r.")


def q_json_defaults(spark, d):
    """P1 on events.props ({"k": n}): the first value of a nested object, and defaults
    for records without the keys."""
    ev = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise(
        F.concat(F.lit('{"_id": '), F.col("props"), F.lit(', "date": '), F.col("props"), F.lit("}")))
    parsed = ev.select("event_id", F.from_json(text, SPAM_SCHEMA).alias("r"))
    feats = featurize_spam_reduced(parsed, prefix="r.")
    return feats.select(F.col("id").alias("id_text"), "time", "long", "lat")


# --- IPv4 (P6, P7, P27, P28) ------------------------------------------------------------

def _orders_ip(a: str, b: str):
    return F.concat_ws(".", (F.col(a) % 256).cast("string"), (F.col(b) % 256).cast("string"),
                       (F.floor(F.col(a) / 256) % 256).cast("string"), (F.floor(F.col(b) / 7) % 256).cast("string"))


def q_ip_to_long(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", MF.ip_to_long(_orders_ip("o_orderkey", "o_custkey")).alias("ip_num"))


def q_long_to_ip(spark, d):
    o = table(spark, d, "orders")
    n = (F.col("o_orderkey") * 2654435761 + F.col("o_custkey")) % 4294967296
    return o.select("o_orderkey", MF.long_to_ip(n).alias("ip_text"))


def _order_keys(spark, d) -> DataFrame:
    return spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"))


def q_ip_set_similarity(spark, d):
    o = _order_keys(spark, d)
    s1 = F.when(F.col("o_orderkey") % 3 == 0, _orders_ip("o_orderkey", "o_custkey")).otherwise(
        F.concat_ws("-", _orders_ip("o_orderkey", "o_custkey"), _orders_ip("o_custkey", "o_orderkey")))
    s2 = F.concat_ws("-", _orders_ip("o_custkey", "o_orderkey"), _orders_ip("o_orderkey", "o_orderkey"))
    one = _orders_ip("o_orderkey", "o_custkey")
    other = _orders_ip("o_custkey", "o_orderkey")
    return o.select("o_orderkey",
                    rnd(MF.ip_similarity(one, other), 9).alias("ip_sim"),
                    rnd(MF.ip_set_similarity(s1, s2), 9).alias("set_sim"),
                    rnd(MF.ip_set_similarity(s1, s2, normalize=True), 9).alias("set_sim_norm"))


def q_ip_set_similarity_large(spark, d):
    """P28 on sets of up to some hundred addresses: the orders of each stretch of keys."""
    o = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / IP_STRETCH).alias("stretch")).agg(
        F.concat_ws("-", F.collect_list(_orders_ip("o_orderkey", "o_custkey"))).alias("a"),
        F.concat_ws("-", F.collect_list(_orders_ip("o_custkey", "o_orderkey"))).alias("b"))
    return o.select("stretch", rnd(MF.ip_set_similarity("a", "b"), 6).alias("set_sim"),
                    rnd(MF.ip_set_similarity("a", "b", normalize=True), 9).alias("set_sim_norm"))


def q_ip_similarity_edges(spark, d):
    """P27 and P28 with short addresses, a trailing dot, and text that is no address."""
    o = _order_keys(spark, d)
    whole, kind = _orders_ip("o_orderkey", "o_custkey"), F.col("o_orderkey") % 5
    start = F.concat_ws(".", (F.col("o_orderkey") % 256).cast("string"), (F.col("o_custkey") % 3).cast("string"))
    x = F.when(kind == 0, start).when(kind == 1, F.lit("_")).when(kind == 2, F.concat(start, F.lit("."))) \
        .when(kind == 3, F.concat(start, F.lit(".x.1"))).otherwise(whole)
    y = F.when(F.col("o_custkey") % 4 == 0, whole).otherwise(_orders_ip("o_orderkey", "o_orderkey"))
    return o.select("o_orderkey", rnd(MF.ip_similarity(x, y), 9).alias("ip_sim"),
                    rnd(MF.ip_set_similarity(F.concat_ws("-", x, y), y), 9).alias("set_sim"))


# --- vectors and points (P11-P19, P21-P23) -------------------------------------------------

def embedding_pairs(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id")  # pair (vec_id, vec_id + 1): an equi-join


def q_vec_algebra(spark, d):
    p = embedding_pairs(spark, d)
    return p.select(
        "vec_id",
        rnd(MF.vec_sum(MF.vec_add("v", "w"))).alias("sum_add"),
        rnd(MF.vec_sum(MF.vec_sub("v", "w"))).alias("sum_sub"),
        rnd(MF.vec_sum(MF.vec_div("v", 2.0))).alias("sum_half"),
        rnd(MF.dot("v", "w")).alias("dot"),
        rnd(MF.norm("v")).alias("norm"),
        rnd(MF.vec_sum(MF.vec_abs("v"))).alias("sum_abs"),
        MF.vec_dim("v").alias("dim"),
        rnd(MF.vec_sum(MF.vec_max("v", "w"))).alias("sum_max"),
        rnd(MF.vec_sum(MF.vec_min("v", "w"))).alias("sum_min"),
        F.size(MF.vec_zip("v", "w")).alias("zip_len"),
    )


def q_vec_weighted_dot(spark, d):
    p = embedding_pairs(spark, d)
    w = F.transform("v", lambda x, i: (i % 2).cast("double"))
    return p.select("vec_id", rnd(MF.weighted_dot("v", w, "w")).alias("wdot"))


def q_dist_euclidean(spark, d):
    return embedding_pairs(spark, d).select("vec_id", rnd(MF.euclidean_arr("v", "w")).alias("dist"))


def q_dist_manhattan(spark, d):
    return embedding_pairs(spark, d).select("vec_id", rnd(MF.manhattan_arr("v", "w")).alias("dist"))


def q_dist_cosine(spark, d):
    return embedding_pairs(spark, d).select("vec_id", rnd(MF.cosine_arr("v", "w")).alias("dist"))


def q_point_algebra(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_totalprice") / 1000).alias("x"),
        F.col("o_custkey").cast("double").alias("y"))
    n = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("x").alias("bx"), F.col("y").alias("by"))
    p = o.join(n, "o_orderkey")
    ax, ay = MF.point_add("x", "y", "bx", "by")
    sx, sy = MF.point_sub("x", "y", "bx", "by")
    nx, ny = MF.point_neg("x", "y")
    dx, dy = MF.point_div("x", "y", 4.0)
    return p.select(
        "o_orderkey", rnd(ax).alias("add_x"), rnd(ay).alias("add_y"), rnd(sx).alias("sub_x"), rnd(sy).alias("sub_y"),
        rnd(nx + 0.0).alias("neg_x"), rnd(ny + 0.0).alias("neg_y"),  # + 0.0 turns -0.0 into 0.0
        rnd(dx, 9).alias("div_x"), rnd(dy, 9).alias("div_y"),
        rnd(MF.point_magnitude("x", "y")).alias("magnitude"),
        rnd(MF.point_distance("x", "y", "bx", "by")).alias("distance"),
        MF.render_point("o_totalprice", "y").alias("text"))  # cents are exact in %.2f


# --- strings (P8, P20, P24, P25) ----------------------------------------------------------

def q_lev(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", MF.levenshtein("p_type", "p_name").alias("lev"))


def q_lev_norm(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", rnd(MF.normalized_levenshtein("p_type", "p_name"), 9).alias("lev_norm"))


def q_longest_term(spark, d):
    p = table(spark, d, "part")
    per_row = p.select("p_brand", MF.longer_term("p_type", "p_name").alias("longer"),
                       MF.shorter_term("p_type", "p_name").alias("shorter"))
    return per_row.groupBy("p_brand").agg(
        MF.longest_term_agg("longer").alias("longest"),
        F.min_by("shorter", F.struct(F.char_length("shorter"), "shorter")).alias("shortest"))


def q_utf8_bytes(spark, d):
    p = table(spark, d, "part")
    b = MF.utf8_bytes(F.concat("p_name", F.lit(" "), "p_brand"))
    return p.select("p_partkey", F.array_join(b, ",").alias("bytes"), F.size(b).alias("n_bytes"))


# --- distances between elements (P29, P30) ----------------------------------------------

def part_pairs(spark, d) -> DataFrame:
    pts, _ = part_points(spark, d)
    a = pts.select(*[F.col(c).alias("a_" + c) for c in pts.columns])
    b = pts.select(*[F.col(c).alias("b_" + c) for c in pts.columns])
    return a.join(b, F.col("b_id") == F.col("a_id") + 1)


def q_feature_distance(spark, d):
    g = part_geometry(1)
    p = part_pairs(spark, d)
    return p.select(F.col("a_id").alias("id"),
                    *[rnd(g.feature_distance(f, cols("a_"), cols("b_")), 9).alias("d_" + f.name) for f in g.features])


def q_element_distance(spark, d):
    p = part_pairs(spark, d)
    return p.select(F.col("a_id").alias("id"),
                    rnd(part_geometry(1).distance(cols("a_"), cols("b_")), 9).alias("dist_mixed"),
                    rnd(part_geometry(0).distance(cols("a_"), cols("b_")), 9).alias("dist_numeric"))


def q_render_elements(spark, d):
    pts, _ = part_points(spark, d)
    nums = [("size", ["p_size"]), ("price", ["p_retailprice"])]
    cats = [("type", "p_type"), ("name", "p_name")]
    return pts.select("id", MF.render_element(F.col("id"), nums, cats).alias("text"))


# --- seeds, assignment (T1, T4, J1, J2, T3) ----------------------------------------------

def q_seed_sample(spark, d):
    pts, _ = part_points(spark, d)
    return sample_seeds(pts, PART_K).select("cluster_id", "id")


def q_suggest_k(spark, d):
    return suggest_k(table(spark, d, "part"))


def q_assign_nearest(spark, d):
    pts, _ = part_points(spark, d)
    g = part_geometry(1)
    out = assign(pts, part_seeds(pts), g, {})
    return out.select("id", "cluster_id", rnd("distance", 9).alias("distance"))


def q_assign_k300(spark, d):
    """300 centroids: the plan over one array of centroids."""
    pts, _ = part_points(spark, d)
    out = assign(pts, part_seeds(pts, MANY_K), part_geometry(1), {})
    return out.select("id", "cluster_id", rnd("distance", 9).alias("distance"))


def q_assign_custom_distance(spark, d):
    """A pandas_udf as a string distance (U2), with more centroids than are spelled out as literals."""
    @F.pandas_udf("double")
    def length_share(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.str.len(), b.str.len()
        return (x - y).abs() / np.maximum(np.maximum(x, y), 1)

    register_distance("categorical", "lengthShare", length_share)
    pts, _ = part_points(spark, d)
    g = Geometry((numeric("size", "p_size"), FeatureSpec("name", "categorical", ("p_name",), "lengthShare")), {"size": 0.5, "name": 0.5}, 1)
    return assign(pts, part_seeds(pts, CUSTOM_K), g).select("id", "cluster_id", rnd("distance", 9).alias("distance"))


def q_kmeans_custom_update(spark, d):
    """A further mode (U1): a centroid is the middle of its cluster's box."""
    def midrange(assigned, geom, order_cols, scratch):
        return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *[((F.min(c) + F.max(c)) / 2).alias(c) for c in geom.numeric_columns])

    pts = orders_points(spark, d).persist(StorageLevel.MEMORY_AND_DISK)
    g = Geometry(ORDERS_FEATURES, ORDERS_WEIGHTS, 0, updates={"Midrange": midrange})
    seeds = [{k: v for k, v in r.asDict().items() if k != "id"} for r in sample_seeds(pts, 5).collect()]
    res = kmeans_mixed(pts, seeds, g, "Midrange", epsilon=-1.0, max_iter=ITERATIONS)
    pts.unpersist()
    return centroid_output(spark, res.centroids, g)


def q_coord_reducers(spark, d):
    """Limits with further reducers."""
    reducers = (("min", F.min), ("spread", lambda c: F.max(c) - F.min(c)), ("known", F.count))
    return coord_limits(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], reducers)


def q_run_trials(spark, d):
    """Totals of trials over logs that are made of the orders: a log for each customer, a line for each order."""
    out = fresh_dir(spark, "trial-logs")
    o = table(spark, d, "orders").where("o_custkey is not null")
    line = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("Task")).otherwise("Job"), F.lit(" finished: step, took "), F.floor("o_totalprice").cast("string"), F.lit(" s"))
    o = o.select(F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("run_label"), line.alias("value"))
    o.repartition(8).write.partitionBy("run_label").text(out)
    return trial_totals(read_run_logs(spark, out)).select("trial", "jobs", "total_seconds")


def _assign_pair(spark, d, distance: str) -> DataFrame:
    """Orders as one 2-D feature; a zero vector among the seeds, and points with a NULL coordinate."""
    pts = orders_points(spark, d)
    seeds = [{k: v for k, v in r.asDict().items() if k != "id"} for r in sample_seeds(pts, 4).collect()]
    seeds.append({"cluster_id": 4, "o_totalprice": 0.0, "o_custkey": 0.0})
    pts = pts.withColumn("o_custkey", F.when(F.col("id") % 97 != 0, F.col("o_custkey")))
    geom = Geometry((numeric("pair", "o_totalprice", "o_custkey", distance=distance),), {"pair": 1.0}, 0)
    return assign(pts, seeds, geom).select("id", "cluster_id", (rnd("distance", 9) + 0.0).alias("distance"))  # no -0.0


def q_assign_cosine(spark, d):
    return _assign_pair(spark, d, "cosine")


def q_assign_manhattan(spark, d):
    return _assign_pair(spark, d, "manhattan")


def q_assign_nearest_2d(spark, d):
    pts = orders_points(spark, d).select("id", F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"))
    seeds = [(r["cluster_id"], r["x"], r["y"]) for r in sample_seeds(pts, 5).collect()]
    return assign_2d(pts, seeds).select("id", "cluster_id")


# --- k-means (K3, K4, K5, K6 and their updates) -------------------------------------------

def _part_kmeans(spark, d, mode: str, m: int) -> DataFrame:
    pts, _ = part_points(spark, d)
    pts = spread(pts).persist(StorageLevel.MEMORY_AND_DISK)
    g = part_geometry(m)
    res = kmeans_mixed(pts, part_seeds(pts), g, mode, epsilon=-1.0, max_iter=ITERATIONS)
    pts.unpersist()
    return centroid_output(spark, res.centroids, g)


def q_kmeans_standard(spark, d):
    return _part_kmeans(spark, d, "Standard", 3)


def q_kmeans_partialsums(spark, d):
    return _part_kmeans(spark, d, "PartialSums", 1)


def q_kmeans_standard_first(spark, d):
    """Standard with one medoid sample: the medoid is the first point of the cluster."""
    return _part_kmeans(spark, d, "Standard", 1)


def q_kmeans_numeric_only(spark, d):
    pts = orders_points(spark, d).persist(StorageLevel.MEMORY_AND_DISK)
    g = Geometry(ORDERS_FEATURES, ORDERS_WEIGHTS, 0)
    seeds = [{k: v for k, v in r.asDict().items() if k != "id"} for r in sample_seeds(pts, 5).collect()]
    res = kmeans_mixed(pts, seeds, g, "Standard", epsilon=-1.0, max_iter=ITERATIONS)
    pts.unpersist()
    return centroid_output(spark, res.centroids, g)


def q_kmeans_partialsums_hicard(spark, d):
    """PartialSums with an almost unique string, for which no dictionary is built."""
    pts = orders_points(spark, d).withColumn("tag", F.concat(
        F.lit("o"), (F.col("id") * 7919 % 1000003).cast("string"), F.lit("-"), F.col("id").cast("string")))
    pts = pts.select("id", "o_totalprice", "tag").persist(StorageLevel.MEMORY_AND_DISK)
    g = Geometry(HICARD_FEATURES, HICARD_WEIGHTS, 1)
    seeds = [{k: v for k, v in r.asDict().items() if k != "id"} for r in sample_seeds(pts, 5).collect()]
    res = kmeans_mixed(pts, seeds, g, "PartialSums", epsilon=-1.0, max_iter=2)
    pts.unpersist()
    return centroid_output(spark, res.centroids, g)


def q_kmeans_keep_empty(spark, d):
    """Two equal seeds: the earlier one never wins a point, and keeps its centroid."""
    pts = orders_points(spark, d).persist(StorageLevel.MEMORY_AND_DISK)
    g = Geometry(ORDERS_FEATURES, ORDERS_WEIGHTS, 0)
    seeds = [{k: v for k, v in r.asDict().items() if k != "id"} for r in sample_seeds(pts, 5).collect()]
    seeds.append(dict(min(seeds, key=lambda s: s["cluster_id"]), cluster_id=5))
    res = kmeans_mixed(pts, seeds, g, "Standard", epsilon=-1.0, max_iter=ITERATIONS, empty="keep")
    pts.unpersist()
    return centroid_output(spark, res.centroids, g)


def q_kmeans2d_converge(spark, d):
    """Runs until no centroid moves more than CONVERGE_EPSILON; the last movement of each."""
    pts = orders_points(spark, d).select("id", F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"))
    pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    res = kmeans_2d(pts, INIT_2D, epsilon=CONVERGE_EPSILON)
    pts.unpersist()
    rows = [(res.iterations, c["cluster_id"], c["x"], c["y"], res.movements[-1][c["cluster_id"]]) for c in res.centroids]
    df = spark.createDataFrame(rows, "iterations int, cluster_id int, x double, y double, movement double")
    return df.select("iterations", "cluster_id", rnd("x").alias("x"), rnd("y").alias("y"), rnd("movement").alias("movement"))


def _out_2d(spark, res) -> DataFrame:
    rows = [(c["cluster_id"], c["x"], c["y"]) for c in res.centroids]
    df = spark.createDataFrame(rows, "cluster_id int, x double, y double")
    return df.select("cluster_id", rnd("x").alias("x"), rnd("y").alias("y"))


def q_kmeans2d_step(spark, d):
    pts = line_points_2d(spark, d)
    return _out_2d(spark, kmeans_2d(pts, INIT_2D, epsilon=-1.0, max_iter=1))


def q_kmeans2d_run(spark, d):
    pts = line_points_2d(spark, d).persist(StorageLevel.MEMORY_AND_DISK)
    out = _out_2d(spark, kmeans_2d(pts, INIT_2D, epsilon=-1.0, max_iter=ITERATIONS))
    pts.unpersist()
    return out


def q_kmeans2d_cells(spark, d):
    """The same iterations on cell summaries."""
    return _out_2d(spark, kmeans_2d_cells(line_points_2d(spark, d), INIT_2D, epsilon=-1.0, max_iter=ITERATIONS, per_cell=1 << 12))


def q_kmeans2d_local_init(spark, d):
    pts = orders_points(spark, d).select("id", F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"))
    pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    init = local_init(pts, "id", LOCAL_INIT_POSITIONS)
    out = _out_2d(spark, kmeans_2d(pts, init, epsilon=-1.0, max_iter=ITERATIONS))
    pts.unpersist()
    return out


# --- evaluation (K7, A9-A13, J4) ------------------------------------------------------------

def q_cluster_radius(spark, d):
    pts, _ = part_points(spark, d)
    st = cluster_stats(pts, part_seeds(pts), part_geometry(1))
    return st.select("cluster_id", "n", rnd("radius", 9).alias("radius"))


def q_inter_distance(spark, d):
    pts, _ = part_points(spark, d)
    g = part_geometry(1)
    cents = centroids_frame(spark, part_seeds(pts), g)
    pairs = centroid_pairs(cents, g).select("cluster_a", "cluster_b", rnd("distance", 9).alias("distance"))
    avg = inter_distance(cents, g).select(F.lit(-1).alias("cluster_a"), F.lit(-1).alias("cluster_b"),
                                          rnd("inter_avg_distance", 9).alias("distance"))
    return pairs.unionByName(avg)


def q_cluster_quality(spark, d):
    pts, _ = part_points(spark, d)
    q = evaluate(pts, part_seeds(pts), part_geometry(1), iterations=0).quality
    return q.select("num_centroids", "num_points", "num_iterations",
                    rnd("inter_avg_distance", 9).alias("inter_avg_distance"),
                    rnd("intra_avg_distance", 9).alias("intra_avg_distance"))


# --- sources and sinks (R2, R3, R5-R8, A14) --------------------------------------------------

def q_random_points(spark, d):
    return random_points(table(spark, d, "orders"), "o_orderkey", seed=42).select(
        F.col("key").alias("o_orderkey"), rnd("x", 9).alias("x"), rnd("y", 9).alias("y"))


def q_points_text_scan(spark, d):
    """Lineitem (quantity, price) written as 'x y' text lines by Spark, read back by R2."""
    path = fresh_dir(spark, "points-text")
    li = table(spark, d, "lineitem")
    li.select(F.concat_ws(" ", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"),
                          F.lit("extra")).alias("value")).write.text(path)
    pts, _bad = read_points_text(spark, path)
    return pts


def _part_run(spark, d, out_root: str, label: str, mode: str):
    params = ClusterParams(mode=mode, k=PART_K, epsilon=-1.0, max_iter=JOB_ITERATIONS, samples_for_medoid=1, weights=PART_WEIGHTS)
    return run_job_on(part_elements(spark, d), params, PART_FEATURES, out_root=out_root, label=label)


def q_run_report(spark, d):
    """The run's log as written, without the lines that hold times."""
    out = fresh_dir(spark, "runs")
    _part_run(spark, d, out, "report", "PartialSums")
    return spark.read.text(f"{out}/log").where(~F.col("value").rlike(JOB_LINE)).select("value")


def q_run_compare(spark, d):
    out = fresh_dir(spark, "runs")
    _part_run(spark, d, out, "partialsums", "PartialSums")
    _part_run(spark, d, out, "standard", "Standard")
    trial = F.regexp_replace("trial", "_d[0-9]{8}T[0-9]{6}$", "")
    return compare_runs(read_run_logs(spark, f"{out}/log")).drop("total_seconds", "run").withColumn("trial", trial)


# --- the full job (K8) -----------------------------------------------------------------------

def _job_params(mode: str, m: int, max_iter: int = JOB_ITERATIONS) -> ClusterParams:
    return ClusterParams(mode=mode, k=JOB_K, epsilon=-1.0, max_iter=max_iter, samples_for_medoid=m, weights=JOB_WEIGHTS)


def _full_job(spark, d, mode: str, m: int):
    return run_job(spark, events_lines(spark, d, False), _job_params(mode, m))


def _job_centroids(spark, result) -> DataFrame:
    names = ["cluster_id", "time", "size", "long", "lat", "ip", "bot", "uri"]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in result.centroids],
                               "cluster_id int, time double, size double, long double, lat double, ip double, bot string, uri string")
    return df.select("cluster_id", rnd(F.col("time") / 1000, 1).alias("time"),
                     *[rnd(c, 2).alias(c) for c in ("size", "long", "lat", "ip")], "bot", "uri")


def q_full_job_standard(spark, d):
    return _job_centroids(spark, _full_job(spark, d, "Standard", 3))


def q_full_job_partialsums(spark, d):
    return _job_centroids(spark, _full_job(spark, d, "PartialSums", 1))


def q_full_job_resumed(spark, d):
    """A job that ended after its first iteration, taken up from its folder by a second one."""
    lines, folder = events_lines(spark, d, False), fresh_dir(spark, "progress")
    run_job(spark, lines, _job_params("Standard", 3, 1), progress_dir=folder, evaluate_output=False)
    return _job_centroids(spark, run_job(spark, lines, _job_params("Standard", 3), progress_dir=folder, evaluate_output=False))


def q_full_job_quality(spark, d):
    """Quality and statistics of the full job, and the sizes that its assignments add up to."""
    res = _full_job(spark, d, "Standard", 1)
    q = res.quality.quality.select(F.explode(F.array(
        F.struct(F.lit("inter").alias("item"), F.col("num_centroids").cast("long").alias("n"), rnd("inter_avg_distance", 9).alias("value")),
        F.struct(F.lit("intra").alias("item"), F.col("num_points").alias("n"), rnd("intra_avg_distance", 9).alias("value")))).alias("x")).select("x.*")
    s = res.quality.stats.select(F.concat(F.lit("radius "), F.col("cluster_id").cast("string")).alias("item"), "n", rnd("radius", 9).alias("value"))
    a = res.assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    a = a.select(F.concat(F.lit("assigned "), F.col("cluster_id").cast("string")).alias("item"), "n", F.lit(None).cast("double").alias("value"))
    return q.unionByName(s).unionByName(a)


QUERIES: dict[str, Query] = {
    "coord_limits": q_coord_limits,
    "minmax_scale": q_minmax_scale,
    "unscale_roundtrip": q_unscale_roundtrip,
    "json_featurize": q_json_featurize,
    "json_featurize_reduced": q_json_featurize_reduced,
    "json_defaults": q_json_defaults,
    "ip_to_long": q_ip_to_long,
    "long_to_ip": q_long_to_ip,
    "ip_set_similarity": q_ip_set_similarity,
    "vec_algebra": q_vec_algebra,
    "vec_weighted_dot": q_vec_weighted_dot,
    "dist_euclidean": q_dist_euclidean,
    "dist_manhattan": q_dist_manhattan,
    "dist_cosine": q_dist_cosine,
    "point_algebra": q_point_algebra,
    "lev": q_lev,
    "lev_norm": q_lev_norm,
    "longest_term": q_longest_term,
    "utf8_bytes": q_utf8_bytes,
    "feature_distance": q_feature_distance,
    "element_distance": q_element_distance,
    "render_elements": q_render_elements,
    "seed_sample": q_seed_sample,
    "suggest_k": q_suggest_k,
    "assign_nearest": q_assign_nearest,
    "assign_nearest_2d": q_assign_nearest_2d,
    "kmeans_standard": q_kmeans_standard,
    "kmeans_standard_first": q_kmeans_standard_first,
    "kmeans_partialsums": q_kmeans_partialsums,
    "kmeans_numeric_only": q_kmeans_numeric_only,
    "kmeans2d_step": q_kmeans2d_step,
    "kmeans2d_run": q_kmeans2d_run,
    "kmeans2d_local_init": q_kmeans2d_local_init,
    "cluster_radius": q_cluster_radius,
    "inter_distance": q_inter_distance,
    "cluster_quality": q_cluster_quality,
    "random_points": q_random_points,
    "points_text_scan": q_points_text_scan,
    "json_lines_scan": q_json_lines_scan,
    "json_rejects": q_json_rejects,
    "ip_similarity_edges": q_ip_similarity_edges,
    "assign_k300": q_assign_k300,
    "assign_custom_distance": q_assign_custom_distance,
    "kmeans_custom_update": q_kmeans_custom_update,
    "coord_reducers": q_coord_reducers,
    "run_trials": q_run_trials,
    "assign_cosine": q_assign_cosine,
    "assign_manhattan": q_assign_manhattan,
    "kmeans_partialsums_hicard": q_kmeans_partialsums_hicard,
    "kmeans_keep_empty": q_kmeans_keep_empty,
    "kmeans2d_converge": q_kmeans2d_converge,
    "full_job_standard": q_full_job_standard,
    "full_job_partialsums": q_full_job_partialsums,
    "full_job_quality": q_full_job_quality,
    "run_report": q_run_report,
    "run_compare": q_run_compare,
    "kmeans2d_cells": q_kmeans2d_cells,
    "full_job_resumed": q_full_job_resumed,
    "ip_set_similarity_large": q_ip_set_similarity_large,
}
