"""Min-max limits (A1), scaling to [0, 1] (K1) and back (K2)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import scale_interval, unscale_interval

Limits = dict[str, tuple[float, float]]  # column -> (min, max)


# (name, aggregate) pairs; any aggregate over one numeric column can be added
Reducers = Sequence[tuple[str, Callable[[str], Column]]]
MIN_MAX: Reducers = (("min", F.min), ("max", F.max))


def coord_limits(df: DataFrame, columns: Sequence[str], reducers: Reducers = MIN_MAX) -> DataFrame:
    """One row: <reducer>_<c> for every column and reducer, in a single pass with partial
    aggregation (one tiny row per task is shuffled)."""
    return df.agg(*[agg(c).alias(f"{name}_{c}") for c in columns for name, agg in reducers])


def fetch_limits(df: DataFrame, columns: Sequence[str]) -> Limits:
    """The limits as driver values: one row of 2 * #columns doubles."""
    row = coord_limits(df, columns).first()
    if empty := [c for c in columns if row[f"min_{c}"] is None]:
        raise ValueError(f"no value to scale by in column(s) {empty}: the input is empty or all NULL there")
    return {c: (float(row[f"min_{c}"]), float(row[f"max_{c}"])) for c in columns}


def minmax_scale(df: DataFrame, limits: Limits) -> DataFrame:
    """Scale the given columns to [0, 1] with the limits inlined as literals, so the
    projection stays a narrow, codegen'd map over the data; other columns pass through."""
    return df.withColumns({c: scale_interval(F.col(c), mx, mn, 1.0, 0.0) for c, (mn, mx) in limits.items()})


def unscale(df: DataFrame, limits: Limits) -> DataFrame:
    return df.withColumns({c: unscale_interval(F.col(c), mx, mn) for c, (mn, mx) in limits.items()})


def unscale_rows(rows: list[dict], limits: Limits) -> list[dict]:
    out = []
    for r in rows:
        r = dict(r)
        for c, (mn, mx) in limits.items():
            if r.get(c) is not None:
                r[c] = r[c] * (mx - mn) + mn
        out.append(r)
    return out
