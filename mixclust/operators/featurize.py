"""From parsed JSON records to elements (P1-P5): one projection, no Python.

Output columns: id (string), numeric coordinates as doubles, categoricals as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_col
from ..functions.ip import ip_to_long

# Defaults of the reference's featurizer.
DEFAULT_ID = "0"
DEFAULT_NUMBER = "0.0"
DEFAULT_CATEGORY = "_"
DEFAULT_IP = "0.0.0.0"
EMPTY_SCALAR = "0.0"  # an empty string value reads as "0.0", for every key but IP


def first_map_value(c, default: str) -> Column:
    """The first value of a nested object (its key name does not matter)."""
    return F.coalesce(F.get(F.map_values(as_col(c)), 0), F.lit(default))


def scalar_with_default(c, default: str) -> Column:
    """The value as text; missing/null -> default; '' -> '0.0'."""
    c = as_col(c)
    return F.when(c.isNull(), F.lit(default)).when(c == "", F.lit(EMPTY_SCALAR)).otherwise(c)


def first_array_entry(c, default: str) -> Column:
    """First entry of an array cut at its first comma; [] -> ''; missing -> default."""
    c = as_col(c)
    first = F.coalesce(F.get(c, 0), F.lit(""))
    return F.when(c.isNull(), F.lit(default)).otherwise(F.split_part(first, F.lit(","), F.lit(1)))


def _num(text: Column) -> Column:
    """A finite number, else NULL (so that the record goes to the rejects)."""
    n = text.try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def featurize_spam(rec: DataFrame, prefix: str = "") -> DataFrame:
    """Id; time, size, long, lat, ip; bot, uri."""
    p = (lambda n: F.col(f"{prefix}{n}")) if prefix else F.col
    ip_text = F.coalesce(p("IP"), F.lit(DEFAULT_IP))  # '' stays '': address 0
    return rec.select(
        first_map_value(p("_id"), DEFAULT_ID).alias("id"),
        _num(first_map_value(p("date"), DEFAULT_NUMBER)).alias("time"),
        _num(scalar_with_default(p("size"), DEFAULT_NUMBER)).alias("size"),
        _num(scalar_with_default(p("long"), DEFAULT_NUMBER)).alias("long"),
        _num(scalar_with_default(p("lat"), DEFAULT_NUMBER)).alias("lat"),
        ip_to_long(ip_text).cast("double").alias("ip"),
        scalar_with_default(p("bot"), DEFAULT_CATEGORY).alias("bot"),
        first_array_entry(p("uri"), DEFAULT_CATEGORY).alias("uri"),
    )


def featurize_spam_reduced(rec: DataFrame, prefix: str = "") -> DataFrame:
    """P5: id; time, long, lat only."""
    p = (lambda n: F.col(f"{prefix}{n}")) if prefix else F.col
    return rec.select(
        first_map_value(p("_id"), DEFAULT_ID).alias("id"),
        _num(first_map_value(p("date"), DEFAULT_NUMBER)).alias("time"),
        _num(scalar_with_default(p("long"), DEFAULT_NUMBER)).alias("long"),
        _num(scalar_with_default(p("lat"), DEFAULT_NUMBER)).alias("lat"),
    )


def split_valid(elements: DataFrame, numeric_columns) -> tuple[DataFrame, DataFrame]:
    """Rows whose numbers did not parse (or an address that is not a quad) go to rejects."""
    ok = F.lit(True)
    for c in numeric_columns:
        ok = ok & F.col(c).isNotNull()
    return elements.where(ok), elements.where(~ok)
