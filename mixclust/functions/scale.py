"""Interval rescaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col


def _num(v) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else as_col(v)


def scale_interval(x, max_, min_, new_max=1.0, new_min=0.0) -> Column:
    """Map x from [min, max] to [new_min, new_max]. A constant column (max = min)
    maps to new_min instead of 0/0."""
    x, mx, mn, nmx, nmn = as_col(x), _num(max_), _num(min_), _num(new_max), _num(new_min)
    scaled = (x - mn) / (mx - mn) * (nmx - nmn) + nmn
    return F.when(mx == mn, nmn).otherwise(scaled)


def unscale_interval(x, max_, min_) -> Column:
    """Inverse of scale_interval to [0, 1]: x * (max - min) + min."""
    return as_col(x) * (_num(max_) - _num(min_)) + _num(min_)
