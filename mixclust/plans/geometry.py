"""The geometry of a mixed element space (U1): feature distances (P29) and the
weighted element distance (P30) as Column expressions.

A "side" is a function from a column name to a Column: the point's own columns, a
prefixed copy, or literals of one centroid. Every distance is then a single JVM
expression, which is what the assignment step evaluates n*k times.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distances import numeric_distance, string_distance
from .params import FeatureSpec, resolve_weights

Side = Callable[[str], Column]
Update = Callable[..., DataFrame]


def cols(prefix: str = "") -> Side:
    return lambda name: F.col(prefix + name)


def literals(row: dict) -> Side:
    def side(name: str) -> Column:
        v = row[name]
        return F.lit(v)
    return side


# Fixed value: numeric feature distances are divided by sqrt(2), whatever the dimension.
NUMERIC_RESCALE = math.sqrt(2.0)


class Geometry:
    """`updates` maps further modes (or 'Standard' / 'PartialSums', to replace them) to an update:
    a function (assigned points, geometry, order columns, scratch) -> DataFrame with cluster_id, n
    and every coordinate and term of the new centroids; DataFrames that it persists go to scratch."""

    def __init__(self, features: Sequence[FeatureSpec], weights: dict[str, float], samples_for_medoid: int,
                 updates: dict[str, Update] | None = None):
        self.updates = dict(updates or {})
        self.features = tuple(features)
        self.weights = resolve_weights(self.features, weights)
        self.samples_for_medoid = int(samples_for_medoid)
        self.numerics = tuple(f for f in self.features if f.kind == "numeric")
        self.categoricals = tuple(f for f in self.features if f.kind == "categorical")
        # categoricals take part in distances only when medoids are sampled
        self.use_categoricals = self.samples_for_medoid != 0
        self.active = self.numerics + (self.categoricals if self.use_categoricals else ())
        for f in self.features:  # fail early on unknown distance names
            (numeric_distance if f.kind == "numeric" else string_distance)(f.distance_name)

    @property
    def numeric_columns(self) -> list[str]:
        return [c for f in self.numerics for c in f.columns]

    @property
    def categorical_columns(self) -> list[str]:
        return [f.column for f in self.categoricals]

    @property
    def active_categoricals(self) -> tuple[FeatureSpec, ...]:
        return self.categoricals if self.use_categoricals else ()

    def feature_distance(self, f: FeatureSpec, a: Side, b: Side) -> Column:
        if f.kind == "numeric":
            d = numeric_distance(f.distance_name)([a(c) for c in f.columns], [b(c) for c in f.columns])
            return d / F.lit(NUMERIC_RESCALE)
        return string_distance(f.distance_name)(a(f.column), b(f.column))

    def weighted(self, f: FeatureSpec, d: Column) -> Column:
        return F.lit(self.weights[f.name]) * d

    def combine(self, weighted_terms: Sequence[Column]) -> Column:
        """sum_f w_f d_f / #active features, summed in feature order."""
        total = weighted_terms[0]
        for t in weighted_terms[1:]:
            total = total + t
        return total / F.lit(float(len(self.active)))

    def distance(self, a: Side, b: Side) -> Column:
        return self.combine([self.weighted(f, self.feature_distance(f, a, b)) for f in self.active])
