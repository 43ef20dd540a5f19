"""Benchmark: the clustering job's stages on the driver's tables.

(l_quantity, l_extendedprice) and 1 string with 500 distinct values -- k = 20.
Times: scaling, one assignment pass, one iteration per mode, the evaluation, the whole
job with maxIter = 2, plus registered queries. A warm-up comes first. Prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from mixclust.operators.assign import assign, build_dictionaries  # noqa: E402
from mixclust.operators.evaluate import evaluate  # noqa: E402
from mixclust.operators.scaling import fetch_limits, minmax_scale  # noqa: E402
from mixclust.operators.seeds import sample_seeds  # noqa: E402
from mixclust.plans.geometry import Geometry  # noqa: E402
from mixclust.plans.job import run_job_on  # noqa: E402
from mixclust.plans.kmeans import kmeans_mixed  # noqa: E402
from mixclust.plans.params import ClusterParams, categorical, numeric  # noqa: E402
from mixclust.session import local_session  # noqa: E402

K = 20
FEATURES = (numeric("qty", "l_quantity"), numeric("price", "l_extendedprice"), categorical("term", "term"))
WEIGHTS = {"qty": 0.3, "price": 0.3, "term": 0.4}


def elements(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        "l_quantity", "l_extendedprice",
        F.concat(F.lit("part-"), (F.col("l_partkey") % 500).cast("string")).alias("term"))


def timed(out, name, fn):
    t0 = time.perf_counter()
    r = fn()
    out[name] = round(time.perf_counter() - t0, 3)
    return r


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="mixclust-bench")
    q: dict[str, float] = {}
    el = elements(spark, d)
    # warm-up, not timed: start the executor threads, read the table once, compile what all stages share
    el.agg(F.sum("l_quantity"), F.max("term")).collect()
    warm = el.limit(2000).persist()
    run_job_on(warm, ClusterParams(mode="PartialSums", k=3, max_iter=1, samples_for_medoid=3, weights=WEIGHTS), FEATURES)
    warm.unpersist()
    geom = Geometry(FEATURES, WEIGHTS, 3)

    def scale():
        lim = fetch_limits(el, ["l_quantity", "l_extendedprice"])
        pts = minmax_scale(el, lim).persist(StorageLevel.MEMORY_AND_DISK)
        n = pts.count()
        return pts, n

    pts, n = timed(q, "scale", scale)
    seeds = [r.asDict() for r in sample_seeds(pts, K).collect()]
    for s in seeds:
        s.pop("id")
    dicts = build_dictionaries(pts, geom, "auto", n, k=K)

    timed(q, "assign_pass", lambda: assign(pts, seeds, geom, dicts).groupBy("cluster_id").count().collect())
    timed(q, "assign_pass_inline", lambda: assign(pts, seeds, geom, {}).groupBy("cluster_id").count().collect())
    res_ps = timed(q, "iteration_partialsums",
                   lambda: kmeans_mixed(pts, seeds, geom, "PartialSums", -1.0, 1, dictionaries=dicts))
    timed(q, "iteration_standard", lambda: kmeans_mixed(pts, seeds, geom, "Standard", -1.0, 1, dictionaries=dicts))
    timed(q, "evaluate", lambda: evaluate(pts, res_ps.centroids, geom, 1, dicts).quality.collect())

    def job():
        params = ClusterParams(mode="PartialSums", k=K, epsilon=0.001, max_iter=2, samples_for_medoid=3, weights=WEIGHTS)
        return run_job_on(el, params, FEATURES).quality.quality.collect()

    timed(q, "job_partialsums_maxiter2", job)
    for td in dicts.values():
        td.release()
    pts.unpersist()

    import workloads as W
    for name in ("kmeans_standard", "kmeans2d_run", "assign_nearest", "assign_k300"):
        timed(q, name, lambda name=name: W.QUERIES[name](spark, d).collect())

    sf = d.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec", "value": round(sum(q.values()), 3), "unit": "sec",
                      "queries": q, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "rows": n}))
    spark.stop()


if __name__ == "__main__":
    main()
