"""Restart of a job from its folder (K8)."""

import pytest
from pyspark.sql import functions as F

from mixclust.operators.evaluate import centroid_pairs, inter_distance
from mixclust.plans.geometry import Geometry
from mixclust.plans.job import run_job_on
from mixclust.plans.params import ClusterParams, categorical, numeric
from mixclust.plans.progress import Progress
from mixclust.session import fresh_dir

FEATURES = (numeric("v", "x", "y"), categorical("t"))
WEIGHTS = {"v": 0.6, "t": 0.4}


def elements(spark, n=400):
    return spark.range(n).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97 / 7.0).alias("y"),
                                 F.concat(F.lit("t"), F.col("id") % 11).alias("t"))


def params(max_iter=4, **more):
    return ClusterParams(mode="Standard", k=5, epsilon=-1.0, max_iter=max_iter, samples_for_medoid=2, weights=WEIGHTS, **more)


def run(spark, p, **more):
    return run_job_on(elements(spark), p, FEATURES, evaluate_output=False, **more)


def test_a_run_that_ended_goes_on_to_the_same_centroids(spark, monkeypatch):
    folder = fresh_dir(spark, "progress")
    whole = run(spark, params())
    save = Progress.save

    def lost(self, iteration, *rest):
        if iteration == 2:
            raise RuntimeError("driver lost")
        save(self, iteration, *rest)

    monkeypatch.setattr(Progress, "save", lost)
    with pytest.raises(RuntimeError, match="driver lost"):
        run(spark, params(), progress_dir=folder)
    ran = []
    monkeypatch.setattr(Progress, "save", lambda self, iteration, *rest: (ran.append(iteration), save(self, iteration, *rest)))
    again = run(spark, params(), progress_dir=folder)
    assert ran == [2, 3, 4] and "Resumed after iteration:\t1" in again.log
    assert again.centroids == whole.centroids and again.result.movements == whole.result.movements
    assert again.result.iterations == 4
    # a run that had come to its end computes nothing
    ran.clear()
    assert run(spark, params(), progress_dir=folder).centroids == whole.centroids and ran == []


def test_more_iterations_later_and_other_jobs_are_refused(spark):
    folder = fresh_dir(spark, "progress")
    run(spark, params(2), progress_dir=folder)
    assert run(spark, params(3), progress_dir=folder).centroids == run(spark, params(3)).centroids
    with pytest.raises(ValueError, match="iterations already"):
        run(spark, params(1), progress_dir=folder)
    with pytest.raises(ValueError, match="other parameters"):
        run(spark, params(3, seed=7), progress_dir=folder)
    with pytest.raises(ValueError, match="points, not"):
        run_job_on(elements(spark, 300), params(3), FEATURES, evaluate_output=False, progress_dir=folder)


def test_an_iteration_with_rows_missing_is_run_again(spark):
    folder = fresh_dir(spark, "progress")
    whole = run(spark, params(3), progress_dir=folder)
    progress = Progress(spark, folder, Geometry(FEATURES, WEIGHTS, 2))
    done = progress.last()
    assert done.iterations == 3
    rows = [(c["cluster_id"], c["x"], c["y"], c["t"], 0.0, 0.0, 5) for c in done.centroids[:3]]
    spark.createDataFrame(rows, progress._schema()).coalesce(1).write.mode("overwrite").parquet(f"{folder}/iterations/iteration=2")
    assert progress.last().iterations == 1
    assert run(spark, params(3), progress_dir=folder).centroids == whole.centroids


@pytest.mark.parametrize("k,tile", [(7, 3), (9, 3), (1, 3), (50, 512), (5000, 512)])
def test_tiles_hold_every_pair_of_centroids_once(spark, k, tile):
    geom = Geometry((numeric("v", "x", "y"),), {"v": 1.0}, 0)
    cents = spark.range(k).select(F.col("id").cast("int").alias("cluster_id"), (F.col("id") * 7 % 13).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    pairs = centroid_pairs(cents, geom, tile)
    row = pairs.agg(F.count(F.lit(1)), F.count_if(F.col("cluster_a") < F.col("cluster_b")), F.sum(F.col("cluster_a").cast("long") * k + F.col("cluster_b")),
                    F.avg("distance")).first()
    n = k * (k - 1) // 2
    assert (row[0], row[1]) == (n, n)
    assert (row[2] or 0) == sum(i * k * (k - 1 - i) + (i + 1 + k - 1) * (k - 1 - i) // 2 for i in range(k))
    assert inter_distance(cents, geom).first()[0] == (None if k == 1 else pytest.approx(row[3]))
    if k == 5000:
        assert pairs.rdd.getNumPartitions() > 8
