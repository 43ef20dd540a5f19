"""Run-log scan (R8), log-line filter (F4) and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The log patterns read from a run log.
JOB_LINE = r"Job finished"
JOB_SECONDS = r"took ([0-9.]+(?:[eE][-+]?[0-9]+)?) s"
BEGIN_QUALITY, END_QUALITY = r"Begin QUALITY", r"Num\t->\tAvg Radius"
QUALITY_FIELDS = {
    "num_centroids": (r"^Num of centroids:\t+([0-9]+)", "bigint"),
    "num_points": (r"^Num of points:\t+([0-9]+)", "bigint"),
    "num_iterations": (r"^Num of Iteration:\t+([0-9]+)", "int"),
    "inter_avg_distance": (r"^Inter Avg Distance\t+([-0-9.eEnaNIifty]+)", "double"),
    "intra_avg_distance": (r"^Intra Avg Distance:\t+([-0-9.eEnaNIifty]+)", "double"),
}


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """trial, run, log: one row per log file (a run's log: a few lines per iteration and cluster).
    The trial is the run_label partition when present, else the parent folder; the run is the file."""
    df = spark.read.text(path, wholetext=True).select(F.col("value").alias("log"), F.col("_metadata.file_path").alias("run"))
    folder = F.regexp_extract("run", r"([^/]+)/[^/]+$", 1)
    return df.select(F.regexp_replace(folder, "^run_label=", "").alias("trial"), "run", "log")


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def job_lines(lines: Column) -> Column:
    """the lines that report a finished job."""
    return F.filter(lines, lambda x: x.rlike(JOB_LINE))


def job_seconds(logs: DataFrame) -> Column:
    """Seconds of each finished job of a log."""
    lines = job_lines(F.split("log", r"\r?\n"))
    seconds = F.transform(lines, lambda x: F.regexp_extract(x, JOB_SECONDS, 1).try_cast("double"))
    return F.filter(seconds, lambda x: x.isNotNull())


def trial_totals(logs: DataFrame) -> DataFrame:
    """One row per trial: number of runs, finished jobs, and their seconds over all logs of the trial."""
    each = logs.select("trial", job_seconds(logs).alias("s"))
    each = each.select("trial", F.size("s").cast("long").alias("jobs"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("seconds"))
    return each.groupBy("trial").agg(F.count(F.lit(1)).alias("runs"), F.sum("jobs").alias("jobs"), F.sum("seconds").alias("total_seconds"))


def compare_runs(logs: DataFrame) -> DataFrame:
    """One row per run of each trial: total job seconds, and the figures between the two
    markers of its quality report."""
    total = F.aggregate(job_seconds(logs), F.lit(0.0), lambda a, x: a + x)
    report = F.split(F.regexp_extract("log", rf"(?s){BEGIN_QUALITY}[^\n]*\n(.*?){END_QUALITY}", 1), r"\r?\n")
    picked = []
    for name, (pattern, kind) in QUALITY_FIELDS.items():
        line = F.get(F.filter(report, _matches(pattern)), 0)
        picked.append(F.regexp_extract(line, pattern, 1).try_cast(kind).alias(name))
    return logs.select("trial", "run", total.alias("total_seconds"), *picked)
