"""JSON-lines scan (R1): a declared schema (no inference, only the needed keys are
parsed), PERMISSIVE mode, malformed lines returned as a second DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# The keys of a spam record read by the featurizer, with the types that
# keep the reference's text semantics (nested objects and numbers arrive as text).
SPAM_SCHEMA = T.StructType([
    T.StructField("_id", T.MapType(T.StringType(), T.StringType())),
    T.StructField("date", T.MapType(T.StringType(), T.StringType())),
    T.StructField("size", T.StringType()),
    T.StructField("long", T.StringType()),
    T.StructField("lat", T.StringType()),
    T.StructField("IP", T.StringType()),
    T.StructField("bot", T.StringType()),
    T.StructField("uri", T.ArrayType(T.StringType())),
])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = SPAM_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): lines read as text and parsed with `from_json`, so a malformed
    line keeps its raw text in `_corrupt_record` and lands in `rejects` instead of failing
    the job. Blank lines are neither; every other line is in exactly one of the two. Only
    the declared keys are materialised."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    good = F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()  # the line `null` is no record
    records = parsed.where(good).select("r.*").drop(CORRUPT)
    return records, parsed.where(~good).select(F.col("value").alias(CORRUPT))
