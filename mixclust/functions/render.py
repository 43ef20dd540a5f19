"""Text rendering of elements and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col
from .ip import long_to_ip

# The reference's text layout.
#   element  : "\n[ID: <id>\n\tNumeric: List(<n1>, <n2>, ...)\n\tCategs: List(<c1>, ...)]"
#   numeric  : "<name>: " then "%.4f " + " " per coordinate; the IP feature as "IP: a.b.c.d"
#   category : "<name>:<term>"
#   point    : "(%.2f - %.2f)";  centroid line: "%3f\t%3f"


def render_numeric(name: str, coords: Sequence) -> Column:
    if name == "IP":
        return F.concat(F.lit("IP: "), long_to_ip(as_col(coords[0])))
    parts = [F.format_string("%.4f  ", as_col(c)) for c in coords]
    return F.concat(F.lit(f"{name}: "), *parts)


def render_categorical(name: str, term) -> Column:
    return F.concat(F.lit(f"{name}:"), as_col(term))


def render_element(id_col, numerics: Sequence[tuple[str, Sequence]], categoricals: Sequence[tuple[str, object]]) -> Column:
    nums = F.concat_ws(", ", *[render_numeric(n, cs) for n, cs in numerics])
    cats = F.concat_ws(", ", *[render_categorical(n, t) for n, t in categoricals]) if categoricals else F.lit("")
    return F.concat(
        F.lit("\n[ID: "), as_col(id_col).cast("string"),
        F.lit("\n\tNumeric: List("), nums,
        F.lit(")\n\tCategs: List("), cats, F.lit(")]"),
    )


def render_point(x, y) -> Column:
    return F.format_string("(%.2f - %.2f)", as_col(x), as_col(y))


def render_centroid_line(x, y) -> Column:
    return F.format_string("%3f\t%3f", as_col(x), as_col(y))
