"""The state of a cluster's update, in one pass over the assigned points.

Each task keeps, for every cluster it meets, the number of points, the coordinate sums, per string column the length of
the shortest term and the sums of the signed bytes up to it, and the first m points in the given order. A state
merges with others in any order: lengths by their minimum, byte sums cut to it, samples by taking the first m
again. So only a row per cluster and task is shuffled, nothing is persisted, and no byte becomes a row.

Where a cluster can hold few different terms (grouped_states), points are first counted and summed by cluster and terms on
the JVM, and the states are made of those groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


_STATE = "cluster_id int, n long, sums array<double>, seen array<long>, shortest array<long>, bytes array<binary>, mean_bytes array<binary>"


def term_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed UTF-8 bytes of a string column without nulls, end to end, with each term's start and length."""
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
    data = np.frombuffer(col.buffers()[2], np.int8) if col.buffers()[2] is not None else np.empty(0, np.int8)
    return data, offs[:-1], np.diff(offs)


def byte_sums(col: pa.Array, group: np.ndarray, groups: int, shortest: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(shortest, sums): per group the least length, at most what is passed in (-1: none yet), and the position-wise
    byte sums of its terms up to that length. Nulls count nowhere; ``times``: how often each term counts."""
    known = col.is_valid().to_numpy(zero_copy_only=False)
    data, start, size = term_bytes(col.drop_null())
    group = group[known]
    least = np.where(shortest < 0, np.iinfo(np.int64).max, shortest)
    np.minimum.at(least, group, size)
    least = np.where(least == np.iinfo(np.int64).max, -1, least)
    width = int(least.max(initial=0))
    take = least[group]
    row = np.repeat(np.arange(len(take)), take)
    at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
    if not len(row):
        return least, np.zeros((groups, max(width, 0)), np.int64)
    value = data[start[row] + at] if times is None else data[start[row] + at] * times[known][row]
    total = np.bincount(group[row] * width + at, weights=value, minlength=groups * width)  # exact below 2^53
    return least, total.astype(np.int64).reshape(groups, width)


def order_key(values: Sequence) -> tuple:
    """Sorts as Spark does: nulls first, NaN last."""
    return tuple((0,) if v is None else (2,) if isinstance(v, float) and math.isnan(v) else (1, v) for v in values)


class State:
    def __init__(self, numerics: int, strings: int):
        self.n = 0
        self.sums, self.seen = np.zeros(numerics), np.zeros(numerics, np.int64)
        self.shortest = [-1] * strings
        self.bytes = [np.zeros(0, np.int64) for _ in range(strings)]
        self.sample: list[dict] = []

    def add_bytes(self, i: int, shortest: int, sums: np.ndarray) -> None:
        if shortest >= 0:
            mine = self.shortest[i]
            cut = shortest if mine < 0 else min(mine, shortest)
            self.bytes[i] = sums[:cut] + (self.bytes[i][:cut] if mine >= 0 else 0)
            self.shortest[i] = cut

    def add_sample(self, rows: list[dict], order: Sequence[str], m: int) -> None:
        self.sample = sorted([*self.sample, *rows], key=lambda r: order_key([r[c] for c in order]))[:m]


def mean_bytes(sums: np.ndarray, n: int) -> bytes:
    """Byte sums / n, truncated toward zero, as bytes."""
    return (np.sign(sums) * (np.abs(sums) // max(n, 1)) & 255).astype(np.uint8).tobytes()


def _first_rows(batch: pa.RecordBatch, order: Sequence[str], m: int) -> pa.Table:
    """The first m rows of each cluster, and maybe more of them."""
    t = pa.Table.from_batches([batch])
    if any(pa.types.is_floating(t.schema.field(c).type) for c in order):
        return t  # NaN would be sorted among the nulls
    at = pc.sort_indices(t, [("cluster_id", "ascending"), *[(c, "ascending") for c in order]], null_placement="at_start").to_numpy()
    cid = batch["cluster_id"].to_numpy()[at]
    begin = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]]))
    rank = np.arange(len(cid)) - np.repeat(begin, np.diff(np.append(begin, len(cid))))
    return t.take(pa.array(at[rank < m]))


def _partial(numerics: list[str], strings: list[str], order: list[str], kept: list[str], m: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, State] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, group = np.unique(b["cluster_id"].to_numpy(), return_inverse=True)
            mine = [states.setdefault(int(c), State(len(numerics), len(strings))) for c in ids]
            for s, n in zip(mine, np.bincount(group, minlength=len(ids)), strict=True):
                s.n += int(n)
            for i, c in enumerate(numerics):
                x = b[c].cast(pa.float64())
                seen = np.bincount(group, weights=x.is_valid().to_numpy(zero_copy_only=False), minlength=len(ids))
                total = np.bincount(group, weights=pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False), minlength=len(ids))
                for s, k, t in zip(mine, seen, total, strict=True):
                    s.seen[i] += int(k)
                    s.sums[i] += t
            for i, c in enumerate(strings):
                least, sums = byte_sums(b[c], group, len(ids), np.array([s.shortest[i] for s in mine], np.int64))
                for s, k, t in zip(mine, least.tolist(), sums, strict=True):
                    s.add_bytes(i, k, t[: max(k, 0)])
            if m:
                rows: dict[int, list[dict]] = {}
                for r in _first_rows(b.select(kept), order, m).to_pylist():
                    rows.setdefault(r["cluster_id"], []).append(r)
                for c, some in rows.items():
                    states[c].add_sample(some, order, m)
        if states:
            yield _record(states, kept, schema)

    return run


def _record(states: dict[int, State], kept: list[str], schema: pa.Schema) -> pa.RecordBatch:
    rows = [{"cluster_id": c, "n": s.n, "sums": s.sums.tolist(), "seen": s.seen.tolist(), "shortest": s.shortest, "bytes": [x.tobytes() for x in s.bytes], "mean_bytes": [mean_bytes(x, s.n) for x in s.bytes],
             "sample": [{k: r[k] for k in kept if k != "cluster_id"} for r in s.sample]} for c, s in states.items()]
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _merged(numerics: int, strings: int, order: list[str], kept: list[str], m: int, schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        out, cid = State(numerics, strings), t["cluster_id"][0].as_py()
        # in one order, so that the sums do not depend on which task came first
        for r in sorted(t.to_pylist(), key=lambda r: (r["n"], r["sums"], r["bytes"])):
            out.n += r["n"]
            out.sums += r["sums"]
            out.seen += r["seen"]
            for i, (k, x) in enumerate(zip(r["shortest"], r["bytes"], strict=True)):
                out.add_bytes(i, k, np.frombuffer(x, np.int64))
            out.add_sample(r["sample"], order, m)
        return pa.Table.from_batches([_record({cid: out}, kept, schema)])

    return run


def cluster_states(assigned: DataFrame, numerics: Sequence[str], strings: Sequence[str] = (), order: Sequence[str] = (),
                   sampled: Sequence[str] = (), m: int = 0) -> DataFrame:
    """One row per cluster: cluster_id, n, sums and seen (of each numeric column: sum and number of its values), shortest,
    bytes and mean_bytes (of each of ``strings``: least length, sums and their means), sample (the first m points in ``order``, with ``order`` and ``sampled``)."""
    numerics, strings, order = list(numerics), list(strings), list(dict.fromkeys(order))
    kept = list(dict.fromkeys(["cluster_id", *order, *sampled])) if m else ["cluster_id"]
    points = assigned.select(*dict.fromkeys([*kept, *numerics, *strings]))
    inner = ", ".join(f"`{c}`: {points.schema[c].dataType.simpleString()}" for c in kept if c != "cluster_id") or "none: int"
    spark_schema = f"{_STATE}, sample array<struct<{inner}>>"
    schema = to_arrow_schema(assigned.sparkSession.createDataFrame([], spark_schema).schema)
    parts = points.mapInArrow(_partial(numerics, strings, order, kept, m, schema), spark_schema)
    return parts.groupBy("cluster_id").applyInArrow(_merged(len(numerics), len(strings), order, kept, m, schema), spark_schema)


def _of_groups(numerics: int, strings: list[str], schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in strings]).combine_chunks()
        out, times = State(numerics, len(strings)), t["__n"].to_numpy()
        out.n = int(times.sum())
        for i in range(numerics):
            out.sums[i] = pc.fill_null(t[f"__sum_{i}"], 0.0).to_numpy().sum()
            out.seen[i] = t[f"__seen_{i}"].to_numpy().sum()
        for i, c in enumerate(strings):
            terms = pa.concat_arrays(t[c].chunks)
            least, sums = byte_sums(terms, np.zeros(len(terms), np.int64), 1, np.array([-1]), times)
            out.add_bytes(i, int(least[0]), sums[0][: max(int(least[0]), 0)])
        return pa.Table.from_batches([_record({t["cluster_id"][0].as_py(): out}, ["cluster_id"], schema)])

    return run


def grouped_states(assigned: DataFrame, numerics: Sequence[str], strings: Sequence[str]) -> DataFrame:
    """cluster_states without a sample, by way of one row per cluster and combination of terms. The combinations of a
    cluster meet in one task: for dictionaries whose sizes bound them (see plans/kmeans.few_groups)."""
    numerics, strings = list(numerics), list(strings)
    spark_schema = _STATE + ", sample array<struct<none: int>>"
    schema = to_arrow_schema(assigned.sparkSession.createDataFrame([], spark_schema).schema)
    sums = [x for i, c in enumerate(numerics) for x in (F.sum(F.col(c).cast("double")).alias(f"__sum_{i}"), F.count(c).alias(f"__seen_{i}"))]
    groups = assigned.groupBy("cluster_id", *strings).agg(F.count(F.lit(1)).alias("__n"), *sums)
    return groups.groupBy("cluster_id").applyInArrow(_of_groups(len(numerics), strings, schema), spark_schema)


def means(states: DataFrame, numerics: Sequence[str]) -> list:
    """Columns of the mean centroid: sum / n, NULL if no point has a value."""
    return [F.when(F.col("seen")[i] > 0, F.col("sums")[i] / F.col("n")).alias(c) for i, c in enumerate(numerics)]


def byte_means_of(strings: Sequence[str]) -> list:
    """Columns of the byte-mean strings; invalid UTF-8 is replaced."""
    return [F.make_valid_utf8(F.col("mean_bytes")[i].cast("string")).alias(c) for i, c in enumerate(strings)]
