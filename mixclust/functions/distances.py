"""Distances (P21-P26) and the pluggable distance registry.

Numeric distances take two equally long lists of coordinate Columns, so the hot path
(assignment) is plain arithmetic inside whole-stage codegen. `*_arr` variants work on
array<double> columns for vector data such as embeddings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V
from .ip import ip_set_similarity
from .strings import levenshtein, normalized_levenshtein


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def euclidean(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(_sum([(x - y) * (x - y) for x, y in zip(a, b)]))


def manhattan(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return _sum([F.abs(x - y) for x, y in zip(a, b)])


def cosine(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """1 - a.b/(|a||b|); NULL when either vector is zero."""
    d = _sum([x * y for x, y in zip(a, b)])
    na = F.sqrt(_sum([x * x for x in a]))
    nb = F.sqrt(_sum([y * y for y in b]))
    den = na * nb
    return F.when(den != 0, F.lit(1.0) - d / den)


def euclidean_arr(a, b) -> Column:
    return V.norm(V.vec_sub(a, b))


def manhattan_arr(a, b) -> Column:
    return V.vec_sum(V.vec_abs(V.vec_sub(a, b)))


def cosine_arr(a, b) -> Column:
    den = V.norm(a) * V.norm(b)
    return F.when(den != 0, F.lit(1.0) - V.dot(a, b) / den)


NumericDistance = Callable[[Sequence[Column], Sequence[Column]], Column]
StringDistance = Callable[[Column, Column], Column]

NUMERIC_DISTANCES: dict[str, NumericDistance] = {
    "euclidean": euclidean,
    "manhattan": manhattan,
    "cosine": cosine,
}

STRING_DISTANCES: dict[str, StringDistance] = {
    "levenshtein": lambda a, b: levenshtein(a, b).cast("double"),
    "normalizedLevenshtein": normalized_levenshtein,
    # distance between two IP sets: 1 - similarity (unbounded below, as the reference)
    "ip": lambda a, b: F.lit(1.0) - ip_set_similarity(a, b),
}


def register_distance(kind: str, name: str, fn) -> None:
    """Add a distance. `fn` must build a Column: (list[Column], list[Column]) -> Column
    for kind 'numeric', (Column, Column) -> Column for kind 'categorical'. A pandas_udf
    is a valid Column builder, at the usual Arrow cost and for any number of centroids."""
    if kind == "numeric":
        NUMERIC_DISTANCES[name] = fn
    elif kind == "categorical":
        STRING_DISTANCES[name] = fn
    else:
        raise ValueError(f"unknown distance kind {kind!r}")


def numeric_distance(name: str) -> NumericDistance:
    try:
        return NUMERIC_DISTANCES[name]
    except KeyError:
        raise ValueError(f"no such distance: {name!r}; known: {sorted(NUMERIC_DISTANCES)}") from None


def string_distance(name: str) -> StringDistance:
    try:
        return STRING_DISTANCES[name]
    except KeyError:
        raise ValueError(f"no such distance: {name!r}; known: {sorted(STRING_DISTANCES)}") from None
