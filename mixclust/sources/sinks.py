"""Sinks: centroids (R5), the quality report (R6) and labelled run outputs.

Everything goes through DataFrame writers to any Spark path. Tables of one run are
written with partitionBy('run_label') under one output root, so runs accumulate side
by side and are read back as one table with run_label as a column.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import render_element
from ..plans.geometry import Geometry

# The reference's report lines.
BEGIN = "Begin QUALITY " + "-" * 100
END = "End QUALITY " + "-" * 100
RADIUS_HEADER = "Num\t->\tAvg Radius"


def run_label(label: str | None = None, when: _dt.datetime | None = None) -> str:
    stamp = (when or _dt.datetime.now()).strftime("d%Y%m%dT%H%M%S")
    return f"{label}_{stamp}" if label else stamp


def centroid_text(centroids: DataFrame, geom: Geometry) -> DataFrame:
    """One rendered line per centroid (ID 'centroid'), ordered by cluster_id."""
    nums = [(f.name, list(f.columns)) for f in geom.numerics]
    cats = [(f.name, f.column) for f in geom.categoricals if f.column in centroids.columns]
    return centroids.select("cluster_id", render_element(F.lit("centroid"), nums, cats).alias("value"))


def number(x: float | None) -> float:
    """A figure that does not exist is printed as nan."""
    return float("nan") if x is None else x


def report_lines(quality_row: dict, stats_rows: list[dict], rendered: dict[int, str]) -> list[str]:
    """R6 text (k + 7 lines). `rendered`: cluster_id -> centroid rendering."""
    lines = [
        BEGIN,
        f"Num of centroids:\t{quality_row['num_centroids']}",
        f"Num of points:\t\t{quality_row['num_points'] or 0}",
        f"Num of Iteration:\t{quality_row['num_iterations']}",
        "Inter Avg Distance\t%3f" % number(quality_row["inter_avg_distance"]),
        "Intra Avg Distance:\t%3f" % number(quality_row["intra_avg_distance"]),
        RADIUS_HEADER,
    ]
    for s in sorted(stats_rows, key=lambda r: r["cluster_id"]):
        lines.append(rendered.get(s["cluster_id"], "") + "\n%d\t->\t%3f" % (s["n"], s["radius"]))
    lines.append(END)
    return lines


def write_run(spark: SparkSession, out_root: str, label: str, tables: dict[str, DataFrame],
              log_lines: list[str], params: dict) -> None:
    """Every table under <out_root>/<name>/run_label=<label>/, plus the run log
    and a one-row copy of the parameters actually used."""
    for name, df in tables.items():
        df.withColumn("run_label", F.lit(label)).write.mode("append").partitionBy("run_label").parquet(f"{out_root}/{name}")
    spark.createDataFrame([(line, label) for line in log_lines], "value string, run_label string") \
        .coalesce(1).write.mode("append").partitionBy("run_label").text(f"{out_root}/log")
    spark.createDataFrame([(json.dumps(params, sort_keys=True), label)], "params string, run_label string") \
        .write.mode("append").partitionBy("run_label").json(f"{out_root}/params")
