"""The full clustering job (K8): scan -> featurize -> scale -> seed -> k-means ->
un-scale -> evaluate -> outputs."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assign import assign, build_dictionaries
from ..operators.evaluate import Quality, evaluate
from ..operators.featurize import featurize_spam, split_valid
from ..operators.scaling import Limits, fetch_limits, minmax_scale, unscale, unscale_rows
from ..operators.seeds import sample_seeds
from ..operators.update import centroids_frame
from ..session import JOB_CONF, spread
from ..sources.json_lines import read_json_lines
from ..sources.sinks import centroid_text, report_lines, run_label, write_run
from .geometry import Geometry
from .kmeans import KMeansResult, kmeans_mixed
from .params import JOB_KEYS, PARAMETER_KEYS, SPAM_FEATURES, ClusterParams, require_keys, suggest_k_value
from .progress import Progress


@dataclass
class JobLog:
    lines: list[str] = field(default_factory=list)

    def timed(self, what: str, fn):
        t0 = time.perf_counter()
        out = fn()
        self.lines.append(f"Job finished: {what}, took {time.perf_counter() - t0:.6f} s")
        return out


@dataclass
class JobResult:
    result: KMeansResult
    centroids: list[dict]           # un-scaled
    limits: Limits
    quality: Quality | None
    report: list[str]
    log: list[str]
    rejects: DataFrame | None
    assignments: DataFrame          # lazy: every element (un-scaled) with cluster_id and distance


def prepare_points(elements: DataFrame, geom: Geometry, log: JobLog, earlier: dict | None = None) -> tuple[DataFrame, Limits]:
    """K1 on the elements. They are persisted (memory, spilling to disk; a small source is dealt to all
    cores first) before the limits are
    taken, so the input is parsed once; a lost partition is rebuilt from the scan. `earlier`: the start of
    the run that is resumed, which holds the limits."""
    elements = spread(elements).persist(StorageLevel.MEMORY_AND_DISK)
    if earlier:
        return elements, {c: tuple(v) for c, v in earlier["limits"].items()}
    limits = log.timed("limits", lambda: fetch_limits(elements, geom.numeric_columns))
    return elements, limits


def read_records(spark: SparkSession, path: str, featurizer=featurize_spam, numeric_columns=("time", "size", "long", "lat", "ip")) -> tuple[DataFrame, DataFrame]:
    """(elements, rejects): the JSON lines of `path` as elements, and the raw or featurized text of
    the lines that are no record."""
    records, bad_json = read_json_lines(spark, path)
    elements, bad_values = split_valid(featurizer(records), numeric_columns)
    rejects = bad_json.select(F.col("_corrupt_record").alias("raw")).unionByName(
        bad_values.select(F.to_json(F.struct(*bad_values.columns)).alias("raw")))
    return elements, rejects


def run_job_on(elements: DataFrame, params: ClusterParams, features=SPAM_FEATURES, out_root: str | None = None,
               label: str | None = None, evaluate_output: bool = True, init: list[dict] | None = None,
               rejects: DataFrame | None = None, source: str = "", empty: str = "drop", geometry: Geometry | None = None,
               progress_dir: str | None = None) -> JobResult:
    """K8 on elements (an `id` column, the features' coordinates and terms): scale, seed (or start
    from `init`: rows of un-scaled coordinates and terms), cluster, un-scale, evaluate, write.

    With `progress_dir`, a shared folder of this job alone, seeds, limits and each iteration's centroids are kept there. A run that finds
    them goes on after the last whole iteration, and ends with the same centroids as a run without a break; it must have
    the same input, number of points and parameters, except that max_iter may be raised (ValueError otherwise)."""
    spark = elements.sparkSession
    for k, v in JOB_CONF.items():  # runtime SQL options; a spark-submit session has none of them
        spark.conf.set(k, v)
    geom = geometry or Geometry(features, params.validate(features), params.samples_for_medoid)
    log = JobLog()
    progress = Progress(spark, progress_dir, geom) if progress_dir else None
    settings = {"mode": params.mode, "k": params.k, "epsilon": params.epsilon, "seed": params.seed,
                "samples_for_medoid": params.samples_for_medoid, "weights": params.weights, "input": source, "empty": empty, "init": init}
    settings = json.loads(json.dumps(settings))
    earlier = progress.started() if progress else None
    if earlier and earlier["parameters"] != settings:
        raise ValueError(f"{progress_dir} holds the iterations of a job with other parameters")
    elements, limits = prepare_points(elements.select("id", *geom.numeric_columns, *geom.categorical_columns), geom, log, earlier)
    points = minmax_scale(elements, limits)  # a narrow projection of what is persisted
    dictionaries: dict = {}
    try:
        n = log.timed("count", points.count)
        done = progress.last() if earlier else None
        if earlier and earlier["n"] != n:
            raise ValueError(f"{progress_dir} holds the iterations of a job on {earlier['n']} points, not {n}")
        if done is not None and done.iterations > params.max_iter:
            raise ValueError(f"{progress_dir} holds {done.iterations} iterations already, more than max_iter = {params.max_iter}")
        if done is not None:
            seeds = done.centroids
            log.lines.append(f"Resumed after iteration:\t{done.iterations}")
        elif init is None:
            k = suggest_k_value(n) if params.k == "auto" else int(params.k)
            seeds = log.timed("seeds", lambda: [r.asDict() for r in sample_seeds(points, k, "id", params.seed).collect()])
            for s in seeds:
                s.pop("id", None)
        else:
            start = minmax_scale(centroids_frame(spark, [dict(c, cluster_id=i) for i, c in enumerate(init)], geom), limits)
            seeds = sorted((r.asDict() for r in start.collect()), key=lambda r: r["cluster_id"])
        if progress and not earlier:
            progress.begin(settings, n, limits, seeds)
        dictionaries = log.timed("dictionaries", lambda: build_dictionaries(points, geom, params.assign_plan, n, k=len(seeds)))
        res = kmeans_mixed(points, seeds, geom, params.mode, params.epsilon, params.max_iter, n_points=n,
                           empty=empty, dictionaries=dictionaries, done=done, after=progress.save if progress else None)
        for i, secs in enumerate(res.seconds, start=1):
            log.lines.append(f"Job finished: iteration {i}, took {secs:.6f} s")
        cents_df = unscale(centroids_frame(spark, res.centroids, geom), limits)
        rendered = {r["cluster_id"]: r["value"] for r in centroid_text(cents_df, geom).collect()}
        quality, report = None, []
        if evaluate_output:
            quality = log.timed("evaluation", lambda: evaluate(points, res.centroids, geom, res.iterations, dictionaries))
            q_row, stats_rows = quality.quality.first().asDict(), [r.asDict() for r in quality.stats.collect()]
            quality = Quality(spark.createDataFrame([q_row], quality.quality.schema), quality.stats)
            report = report_lines(q_row, stats_rows, rendered)
            if n > (q_row["num_points"] or 0):
                log.lines.append(f"Points without a nearest centroid:\t{n - (q_row['num_points'] or 0)}")
        if out_root:
            tables = {"centroids": cents_df}
            if quality is not None:
                tables.update({"quality": quality.quality, "cluster_stats": quality.stats})
            lines = [f"Num of Iteration:\t{res.iterations}", *[rendered[c] for c in sorted(rendered)], *log.lines, *report]
            write_run(spark, out_root, run_label(label), tables, lines, {
                "mode": params.mode, "initialCentroids": params.k, "convergeDist": params.epsilon,
                "maxIter": params.max_iter, "numSamplesForMedoid": params.samples_for_medoid,
                "weights": params.weights, "input": source})
        assignments = unscale(assign(minmax_scale(elements, limits), res.centroids, geom), limits)
        return JobResult(res, unscale_rows(res.centroids, limits), limits, quality, report, log.lines, rejects, assignments)
    finally:
        for td in dictionaries.values():
            td.release()
        elements.unpersist()


def run_job(spark: SparkSession, input_path: str, params: ClusterParams, features=SPAM_FEATURES,
            featurizer=featurize_spam, **options) -> JobResult:
    """K8 on a path of JSON lines; further options as in run_job_on."""
    numbers = [c for f in features if f.kind == "numeric" for c in f.columns]
    elements, rejects = read_records(spark, input_path, featurizer, numbers)
    return run_job_on(elements, params, features, rejects=rejects, source=input_path, **options)


def read_conf(spark: SparkSession, path: str, keys, what: str) -> dict:
    """A JSON object from a file on any path that Spark reads, with all of `keys`."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    conf = json.loads(text)
    require_keys(conf, keys, what)
    return conf


def run_from_files(spark: SparkSession, out_root: str, conf_path: str, parameter_path: str, **options) -> JobResult:
    """K8 from the two configuration files. `host` and `appName` must be there, but belong to
    whoever made the session; `evalOutput` 1 asks for the evaluation."""
    conf = read_conf(spark, conf_path, JOB_KEYS, "job configuration")
    params = ClusterParams.from_conf(read_conf(spark, parameter_path, PARAMETER_KEYS, "parameter file"))
    return run_job(spark, conf["inputFile"], params, out_root=out_root, evaluate_output=int(conf["evalOutput"]) == 1,
                   label=conf["appName"], **options)
