"""Nearest-centroid assignment on a stream.

Against fixed centroids J1 is a stateless projection (scale with fixed limits, then the
literal arg-min), so it runs unchanged on a streaming DataFrame: no state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.assign import assign
from ..operators.scaling import Limits, minmax_scale
from ..plans.geometry import Geometry


def assign_stream(stream: DataFrame, centroids: list[dict], geom: Geometry, limits: Limits) -> DataFrame:
    """`centroids` are in the scaled space (as returned by the batch job)."""
    return assign(minmax_scale(stream, limits), centroids, geom, None, distance_col="distance")
