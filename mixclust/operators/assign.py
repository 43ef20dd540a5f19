"""Nearest-centroid assignment (J1, J2) with the arg-min tie rule.

The k centroids are driver values (k rows, collected once per iteration) and enter the
plan as literals: the assignment is a narrow projection over the points, with no join
and no shuffle. For each point the candidates are compared as struct(distance,
-cluster_id), so an equal distance goes to the later centroid, as in the reference's left
fold. A distance that is NULL or NaN never wins against a number; a point without any
distance gets the cluster_id NULL.

Up to MOST_LITERALS centroids the candidates are spelled out (`least` of k structs, plain
codegen'd arithmetic). Beyond, the plan's size doesn't depend on k; all plans give the same answers:
- built-in distances without a dictionary: branch and bound in blocks of points (pruned.py), where
  most candidates are ruled out by bounds and few edit distances are computed;
- other Column distances, or with a dictionary: the centroids are one array literal and the
  candidates its transform;
- distances that cannot be in a lambda, as a pandas_udf: each point is put beside each centroid
  within its task, and the best is kept as the rows pass; nothing is shuffled.

Levenshtein dominates the cost (n*k evaluations per categorical). When a categorical
column has few distinct terms, the *term dictionary* plan computes the weighted
distances of each distinct term to the k centroids once (d*k evaluations, one array per
term) and joins them back by term. `auto` takes it only where the estimated dictionary is
small enough to be broadcast, so no iteration shuffles the points.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distances as D
from ..functions.vectors import point_distance
from ..plans.geometry import NUMERIC_RESCALE, Geometry, cols, literals
from . import pruned

DEFAULT_BROADCAST_MAX_BYTES = 64 << 20
# auto plan: use a dictionary when distinct terms are at most this share of the points
DICTIONARY_MAX_SHARE = 0.25
MOST_LITERALS = 32


def _candidate(distance: Column, order: Column) -> Column:
    """NULL counts as NaN, which sorts after every number (a NULL would sort first)."""
    return F.struct(F.coalesce(distance, F.lit(float("nan"))).alias("d"), order.alias("o"))


def _argmin(candidates: list[tuple[Column, int]]) -> Column:
    structs = [_candidate(d, F.lit(-cid)) for d, cid in candidates]
    return structs[0] if len(structs) == 1 else F.least(*structs)


def _with_best(df: DataFrame, best: Column, id_col: str, distance_col: str | None) -> DataFrame:
    df = df.withColumn("__best", best)
    found = ~F.isnan("__best.d")
    df = df.withColumn(id_col, F.when(found, -F.col("__best.o")).cast("int"))
    if distance_col:
        df = df.withColumn(distance_col, F.when(found, F.col("__best.d")))
    return df.drop("__best")


def centroid_array(centroids: list[dict], geom: Geometry) -> Column:
    """The centroids as one literal: array<struct<cluster_id, coordinates, terms>>."""
    names = ["cluster_id", *geom.numeric_columns, *geom.categorical_columns]
    kinds = ["int", *["double"] * len(geom.numeric_columns), *["string"] * len(geom.categorical_columns)]
    schema = "array<struct<" + ", ".join(f"`{n}`: {k}" for n, k in zip(names, kinds)) + ">>"
    return F.from_json(F.lit(json.dumps([{n: c.get(n) for n in names} for c in centroids])), schema)


@dataclass
class TermDictionary:
    column: str
    terms: DataFrame          # one column __term, distinct, persisted
    n_terms: int
    term_bytes: int
    broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES

    @classmethod
    def build(cls, points: DataFrame, column: str, broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES):
        # distinct = partial aggregation per task first, so a hot term costs one row per task
        terms = points.select(F.col(column).alias("__term")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        row = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("__term")).alias("b")).first()
        return cls(column, terms, int(row["n"]), int(row["b"] or 0), broadcast_max_bytes)

    def estimated_bytes(self, k: int) -> int:
        return self.term_bytes + self.n_terms * (8 * k + 64)

    def broadcastable(self, k: int) -> bool:
        return self.estimated_bytes(k) <= self.broadcast_max_bytes

    def release(self) -> None:
        self.terms.unpersist()


def build_dictionaries(points: DataFrame, geom: Geometry, plan: str = "auto", n_points: int | None = None,
                       broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES, k: int = 100) -> dict[str, TermDictionary]:
    """Term dictionaries for the active categorical columns, per the plan:
    'inline' -> none; 'dictionary' -> all (joined by a shuffle where too large); 'auto' ->
    where distinct terms are few and their distances to k centroids can be broadcast.

    'auto' decides from one pass of HyperLogLog sketches (`approx_count_distinct`, merged
    map-side, a few KB per task) and mean term sizes, so a high-cardinality column never pays
    for an exact distinct -- a full shuffle of its values -- only to be rejected."""
    if plan not in ("auto", "inline", "dictionary"):
        raise ValueError(f"unknown assignment plan {plan!r}")
    cats = [f.column for f in geom.active_categoricals]
    if plan == "inline" or not cats:
        return {}
    chosen = cats
    if plan == "auto":
        row = points.agg(F.count(F.lit(1)).alias("__n"),
                         *[F.approx_count_distinct(c, 0.05).alias(c) for c in cats],
                         *[F.avg(F.octet_length(c)).alias(f"__b_{c}") for c in cats]).first()
        n = n_points or row["__n"]
        size = {c: row[c] * ((row[f"__b_{c}"] or 0) + 8 * k + 64) for c in cats}
        chosen = [c for c in cats if row[c] <= DICTIONARY_MAX_SHARE * n and size[c] <= broadcast_max_bytes]
    return {c: TermDictionary.build(points, c, broadcast_max_bytes) for c in chosen}


_BUILT_IN = {**{("numeric", n): D.NUMERIC_DISTANCES[n] for n in pruned.NUMERIC},
             **{("categorical", n): D.STRING_DISTANCES[n] for n in pruned.STRINGS}}


def search_parts(geom: Geometry) -> list[pruned.Part] | None:
    """The active features for the pruned plan; None if a distance is not (or no more) a built-in one."""
    parts = []
    for f in geom.active:
        table = D.NUMERIC_DISTANCES if f.kind == "numeric" else D.STRING_DISTANCES
        if _BUILT_IN.get((f.kind, f.distance_name)) is not table.get(f.distance_name):
            return None
        parts.append(pruned.Part(f.kind, f.distance_name, tuple(f.columns), geom.weights[f.name]))
    return parts


def _schema_with(df: DataFrame, id_col: str, distance_col: str | None) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return ", ".join([*kept, f"`{id_col}` int", *([f"`{distance_col}` double"] if distance_col else [])])


def _assign_pruned(points: DataFrame, centroids: list[dict], geom: Geometry, parts: list[pruned.Part],
                   id_col: str, distance_col: str | None) -> DataFrame:
    points = points.drop(id_col, *([distance_col] if distance_col else []))
    search = pruned.Search(centroids, parts, NUMERIC_RESCALE)
    return points.mapInArrow(pruned.assign_blocks(search, id_col, distance_col), _schema_with(points, id_col, distance_col))


def _best_of_each(n_columns: int, k: int, id_col: str, distance_col: str | None):
    """From rows point x centroid (all centroids of a point in a row): each point once, with its best."""

    def best(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        d = t["__d"].fill_null(float("nan")).to_numpy().reshape(-1, k)
        cid = t["__c"].to_numpy().reshape(-1, k)
        at = np.lexsort((-cid, d), axis=1)[:, 0]  # NaN last, then the later id
        row = np.arange(len(d))
        none = np.isnan(d[row, at])
        out = t.take(pa.array(row * k)).columns[:n_columns]
        arrays, names = [*out, pa.array(cid[row, at], pa.int32(), mask=none)], [*t.schema.names[:n_columns], id_col]
        if distance_col:
            arrays, names = [*arrays, pa.array(d[row, at], pa.float64(), mask=none)], [*names, distance_col]
        return pa.table(arrays, names=names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            whole = n - n % k
            if whole:
                t = pa.Table.from_batches(held)
                yield from best(t.slice(0, whole).to_batches())
                held, n = t.slice(whole).to_batches(), n - whole

    return run


def _assign_beside(points: DataFrame, centroids: list[dict], geom: Geometry, id_col: str, distance_col: str | None) -> DataFrame:
    points = points.drop(id_col, *([distance_col] if distance_col else []))
    beside = points.withColumn("__centroid", F.explode(centroid_array(centroids, geom)))
    d = geom.distance(cols(), lambda n: F.col("__centroid")[n])
    rows = beside.select(*points.columns, d.alias("__d"), F.col("__centroid.cluster_id").alias("__c"))
    return rows.mapInArrow(_best_of_each(len(points.columns), len(centroids), id_col, distance_col), _schema_with(points, id_col, distance_col))


def assign(points: DataFrame, centroids: list[dict], geom: Geometry,
           dictionaries: dict[str, TermDictionary] | None = None,
           id_col: str = "cluster_id", distance_col: str | None = "distance") -> DataFrame:
    """Add `id_col` (nearest centroid) and, unless None, `distance_col` to every point."""
    if not centroids:
        raise ValueError("no centroid to assign to")
    dictionaries = dictionaries or {}
    k, large = len(centroids), len(centroids) > MOST_LITERALS
    if large and not dictionaries and (parts := search_parts(geom)) is not None:
        return _assign_pruned(points, centroids, geom, parts, id_col, distance_col)
    try:
        return _assign_columns(points, centroids, geom, dictionaries, id_col, distance_col, k, large)
    except AnalysisException as e:
        if not large or "LAMBDA_FUNCTION_WITH_PYTHON_UDF" not in (e.getCondition() or ""):
            raise
        return _assign_beside(points, centroids, geom, id_col, distance_col)


def _assign_columns(points: DataFrame, centroids: list[dict], geom: Geometry, dictionaries: dict[str, TermDictionary],
                    id_col: str, distance_col: str | None, k: int, large: bool) -> DataFrame:
    array = centroid_array(centroids, geom)
    df = points
    tables: dict[str, list[str]] = {}  # categorical column -> its columns of distances: one array, or k doubles
    helpers: list[str] = []
    for f in geom.active:
        td = dictionaries.get(f.column) if f.kind == "categorical" else None
        if td is None:
            continue
        term, dist = f"__t_{f.column}", f"__d_{f.column}"
        to_each = lambda side, _f=f, _t=term: geom.weighted(_f, geom.feature_distance(_f, lambda _n: F.col(_t), side))
        # few centroids: one double column each, as plain column reads keep the arg-min's code small
        each = [F.transform(array, lambda c: to_each(lambda n: c[n]))] if large else [to_each(literals(c)) for c in centroids]
        names = [f"{dist}_{j}" for j in range(len(each))]
        table = td.terms.select(F.col("__term").alias(term)).select(term, *[e.alias(n) for e, n in zip(each, names)])
        if td.broadcastable(k):
            table = F.broadcast(table)
        df = df.join(table, df[f.column].eqNullSafe(table[term]), "left")
        tables[f.column] = names
        helpers += [term, *names]

    def distance(side, at: Column | int) -> Column:
        read = lambda names: F.col(names[at]) if isinstance(at, int) else F.get(F.col(names[0]), at)
        terms = [read(tables[f.column]) if f.kind == "categorical" and f.column in tables
                 else geom.weighted(f, geom.feature_distance(f, cols(), side)) for f in geom.active]
        return geom.combine(terms)

    if large:
        best = F.array_min(F.transform(array, lambda c, i: _candidate(distance(lambda n: c[n], i), -c["cluster_id"])))
    else:
        best = _argmin([(distance(literals(c), j), int(c["cluster_id"])) for j, c in enumerate(centroids)])
    return _with_best(df, best, id_col, distance_col).drop(*helpers)


def assign_2d(points: DataFrame, centroids: list[tuple[int, float, float]], x: str = "x", y: str = "y",
              id_col: str = "cluster_id", distance_col: str | None = None) -> DataFrame:
    """Euclidean nearest of (cluster_id, cx, cy) centroids, ties to the later one."""
    return _with_best(points, _argmin(_candidates_2d(centroids, x, y)), id_col, distance_col)


def _candidates_2d(centroids: list[tuple[int, float, float]], x: str, y: str) -> list[tuple[Column, int]]:
    return [(point_distance(F.col(x), F.col(y), F.lit(float(cx)), F.lit(float(cy))), int(cid)) for cid, cx, cy in centroids]


def anchor_2d(points: DataFrame, centroids: list[tuple[int, float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """x, y, anchor_id (as by assign_2d), nearest and second: the distances of the nearest centroid and of the next
    (infinite for a single centroid). They are the bounds that assign_bounded_2d loosens."""
    each = [(F.col(f"__d{j}"), cid) for j, (_, cid) in enumerate(_candidates_2d(centroids, x, y))]
    apart = points.select(x, y, *[d.alias(f"__d{j}") for j, (d, _) in enumerate(_candidates_2d(centroids, x, y))])
    ranked = _with_best(apart, _argmin(each), "anchor_id", "nearest")
    others = [F.when(F.col("anchor_id") != cid, d) for d, cid in each]
    return ranked.select(x, y, "anchor_id", "nearest", F.least(F.lit(float("inf")), *others).alias("second"))


def assign_bounded_2d(anchored: DataFrame, anchors: list[tuple[int, float, float]], centroids: list[tuple[int, float, float]],
                      x: str = "x", y: str = "y", id_col: str = "cluster_id", certain_col: str = "certain") -> DataFrame:
    """J2 with bounds (Euclid only): ``anchored`` holds the distances to the centroids ``anchors``, which have moved to
    ``centroids`` since. By the triangle inequality a point is at most nearest + (way of its centroid) from its own, and
    at least second - (longest way) from any other. Where the former is less, ``certain_col`` is true and no distance is
    computed; the other points are compared with all centroids. Same ids as assign_2d."""
    where = {cid: (cx, cy) for cid, cx, cy in centroids}
    way = {cid: float(np.hypot(where[cid][0] - cx, where[cid][1] - cy)) for cid, cx, cy in anchors}
    own = F.lit(0.0)
    for cid, w in way.items():
        if w:
            own = F.when(F.col("anchor_id") == cid, F.lit(w)).otherwise(own)
    longest = F.lit(max(way.values()))
    below, above = F.col("nearest") + own, F.col("second") - longest
    # the margin covers the rounding of distances, so that a tie is never decided by the bounds
    sure = F.coalesce((above - below > (below + longest) * 1e-9) & ~F.isnan("second"), F.lit(False)) & F.col("anchor_id").isNotNull()
    best = _argmin(_candidates_2d(centroids, x, y))
    df = anchored.withColumn(certain_col, sure).withColumn("__best", F.when(~F.col(certain_col), best))
    found = F.when(~F.isnan("__best.d"), -F.col("__best.o")).cast("int")
    return df.withColumn(id_col, F.when(F.col(certain_col), F.col("anchor_id")).otherwise(found)).drop("anchor_id", "nearest", "second", "__best")
