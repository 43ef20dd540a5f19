"""Numeric vectors stored as array<double> columns (P11-P19) and 2-D points.

Arrays of unequal length are cut to the shorter one first, as a pairwise zip does;
`zip_with` alone would pad with NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col


def _pair(a, b) -> tuple[Column, Column]:
    a, b = as_col(a), as_col(b)
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def vec_add(a, b) -> Column:
    x, y = _pair(a, b)
    return F.zip_with(x, y, lambda p, q: p + q)


def vec_sub(a, b) -> Column:
    x, y = _pair(a, b)
    return F.zip_with(x, y, lambda p, q: p - q)


def vec_div(a, d) -> Column:
    """Each coordinate divided by a scalar; division by zero gives NULL coordinates."""
    d = as_col(d) if not isinstance(d, (int, float)) else F.lit(float(d))
    return F.transform(as_col(a), lambda x: F.try_divide(x, d))


def vec_zip(a, b) -> Column:
    x, y = _pair(a, b)
    return F.arrays_zip(x.alias("x"), y.alias("y"))


def vec_sum(a) -> Column:
    return F.aggregate(as_col(a), F.lit(0.0), lambda acc, x: acc + x)


def vec_abs(a) -> Column:
    return F.transform(as_col(a), lambda x: F.abs(x))


def vec_dim(a) -> Column:
    return F.size(as_col(a))


def dot(a, b) -> Column:
    x, y = _pair(a, b)
    return vec_sum(F.zip_with(x, y, lambda p, q: p * q))


def weighted_dot(a, w, b) -> Column:
    """sum_i a_i * w_i * b_i over the common length of the three arrays."""
    a, w, b = as_col(a), as_col(w), as_col(b)
    n = F.least(F.size(a), F.size(w), F.size(b))
    aw = F.zip_with(F.slice(a, 1, n), F.slice(w, 1, n), lambda p, q: p * q)
    return vec_sum(F.zip_with(aw, F.slice(b, 1, n), lambda p, q: p * q))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def vec_max(a, b) -> Column:
    x, y = _pair(a, b)
    return F.zip_with(x, y, lambda p, q: F.when(p > q, p).otherwise(q))


def vec_min(a, b) -> Column:
    x, y = _pair(a, b)
    return F.zip_with(x, y, lambda p, q: F.when(p < q, p).otherwise(q))


# --- 2-D points held as two double columns ------------------------------------

def point_add(ax, ay, bx, by) -> tuple[Column, Column]:
    return as_col(ax) + as_col(bx), as_col(ay) + as_col(by)


def point_sub(ax, ay, bx, by) -> tuple[Column, Column]:
    return as_col(ax) - as_col(bx), as_col(ay) - as_col(by)


def point_neg(x, y) -> tuple[Column, Column]:
    return -as_col(x), -as_col(y)


def point_div(x, y, d) -> tuple[Column, Column]:
    d = F.lit(float(d)) if isinstance(d, (int, float)) else as_col(d)
    return F.try_divide(as_col(x), d), F.try_divide(as_col(y), d)


def point_magnitude(x, y) -> Column:
    x, y = as_col(x), as_col(y)
    return F.sqrt(x * x + y * y)


def point_distance(ax, ay, bx, by) -> Column:
    dx = as_col(bx) - as_col(ax)
    dy = as_col(by) - as_col(ay)
    return F.sqrt(dx * dx + dy * dy)
