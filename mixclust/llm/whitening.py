"""Whitening of embeddings by a weighted covariance over distinct vectors.

1. Components become integers, x = floor(scale * c) + shift, and equal vectors one row with their count. They are
   the fit list; a vector's weight there is one, or its count.
2. Total weight n and the exact sums S, then the covariance: every task centres its vectors before it multiplies
   (x minus the integral part of S / n is exact) and adds up its weighted products; the tasks' matrices are
   added row by row, and the driver gets one matrix of dims x dims.
3. Unit eigenvectors by falling eigenvalue; of either sign the one whose largest entry is positive.
4. Each distinct vector is whitened once and written; rows get theirs by a join on the vector. The covariance of what
   was written, minus the identity, tells how well it went.

Defined cases: a vector that is null, or holds a null or a non-finite component, or one whose integer is beyond
62 bits, takes no part. Shorter vectors count as padded with zeros. A row with a null id takes part. Repeated rows
each get their result. A component without variance (eigenvalue at most dims * 2^-52 of the largest) is 0 in
all rows and no part of identity_error; explained is null if there is no variance at all, and identity_error then
too. A deviation beyond 63 bits is null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.session import written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
AT_ONCE = 8192
_LARGEST = 2.0**62
_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _valid(column: str) -> F.Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(1.7976931348623157e308)) & (F.abs(c * SCALE) + SHIFT < _LARGEST)
    return F.col(column).isNotNull() & F.forall(F.col(column), lambda c: finite(c.cast("double")))


def _integers(dims: int) -> Callable:
    """(vec_id, x): the integers of each vector, packed as 32-bit numbers where all of a vector fit, else as 64-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                rows = b.slice(at, AT_ONCE)
                col = rows["v"]
                size = np.diff(col.offsets.to_numpy())
                flat = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                x = np.zeros((len(col), dims))
                row = np.repeat(np.arange(len(col)), size)
                x[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
                x = x.astype(np.int64) + SHIFT
                small = (np.abs(x) < 2**31).all(1)
                packed = [v.astype(np.int32).tobytes() if s else v.tobytes() for v, s in zip(x, small, strict=True)]
                yield pa.RecordBatch.from_arrays([rows["vec_id"], pa.array(packed, pa.binary())], names=["vec_id", "x"])

    return run


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    parts = col.to_pylist()
    if all(len(p) == 4 * dims for p in parts):
        return np.frombuffer(b"".join(parts), np.int32).reshape(-1, dims).astype(np.int64)
    return np.stack([np.frombuffer(p, np.int32 if len(p) == 4 * dims else np.int64).astype(np.int64) for p in parts])


def _sums(dims: int) -> Callable:
    """(dim, s): exact weighted sums of a task; dim -1 has the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = [0] * dims, 0
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                rows = b.slice(at, AT_ONCE)
                w, x = rows["weight"].to_numpy(), _matrix(rows["x"], dims)
                for one in np.unique(w).tolist():  # 32-bit halves add up without overflow
                    y = x[w == one]
                    high, low = (y >> 32).sum(0).tolist(), (y & 0xFFFFFFFF).sum(0).tolist()
                    total = [t + one * ((h << 32) + v) for t, h, v in zip(total, high, low, strict=True)]
                    weight += one * len(y)
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array([Decimal(v) for v in (weight, *total)], pa.decimal128(38, 0))], names=["dim", "s"])

    return run


@dataclass
class Centre:
    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.part = np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exact."""
        most = float(np.abs(self.centred(x)).max(initial=0)) * self.n + 1
        rest = [s % self.n for s in self.sums]
        if most * most * x.shape[1] < 2.0**62:
            return ((self.n * (x - self.whole) - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in (x - self.whole).tolist()]
        return [v if v < 2**63 else None for v in exact]


def _products(rows_of: Callable[[pa.RecordBatch], np.ndarray], dims: int) -> Callable:
    """(i, row): of a task, the weighted products of all pairs of columns; row dims has the weighted sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = np.zeros((dims + 1, dims)), False
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                rows = b.slice(at, AT_ONCE)
                y, w = rows_of(rows), rows["weight"].to_numpy().astype(np.float64)
                weighted = y * w[:, None]
                m[:-1] += weighted.T @ y
                m[-1] += weighted.sum(0)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["i", "row"])

    return run


def _added(table: pa.Table) -> pa.Table:
    rows = sorted(table["row"].to_pylist())  # in one order, so that a second run adds alike
    total = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1).sum(0)
    return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})


def _moments(vectors: DataFrame, rows_of: Callable, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted products (dims x dims) and sums of the rows, added over all tasks: dims + 1 rows for the driver."""
    parts = vectors.mapInArrow(_products(rows_of, dims), "i int, row binary").groupBy("i").applyInArrow(_added, "i int, row binary")
    m = np.zeros((dims + 1, dims))
    for r in parts.collect():
        m[r["i"]] = np.frombuffer(r["row"], np.float64)
    return m[:-1], m[-1]


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Eigenvalues (falling), unit eigenvectors as columns, and the trace (None: no variance)."""
    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    at = np.abs(vector).argmax(0)
    vector = vector * np.where(vector[at, np.arange(vector.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    return value, vector, trace if trace > 0 else None


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weights: str = "one", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each row that takes part and each component: vec_id, component (from 1), n (total weight), deviation,
    whitened, explained, identity_error. ``weights``: "one" for each distinct vector, or its "count"."""
    if weights not in ("one", "count"):
        raise ValueError(f"weights must be 'one' or 'count', got {weights!r}")
    spark = embeddings.sparkSession
    part = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(_valid("v"))
    dims = part.agg(F.max(F.size("v"))).first()[0]
    empty = spark.createDataFrame([], _ROWS)
    if not dims:
        return empty
    rows = part.mapInArrow(_integers(dims), "vec_id long, x binary")
    weight = F.count(F.lit(1)) if weights == "count" else F.max(F.lit(1).cast("long"))
    distinct = written(rows.groupBy("x").agg(weight.alias("weight")), "distinct-vectors")

    sums = {r["dim"]: int(r["s"]) for r in distinct.mapInArrow(_sums(dims), "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    centre = Centre(sums[-1], [sums[i] for i in range(dims)])
    products, offset = _moments(distinct, lambda b: centre.centred(_matrix(b["x"], dims)), dims)
    rest = offset / centre.n  # what rounding has left of the centre
    value, axes, trace = principal(products / centre.n - np.outer(rest, rest), min(components, dims))
    has = value > max(value[0], 0.0) * dims * 2.0**-52
    spread = np.where(has, 1 / np.sqrt(np.where(has, value, 1.0)), 0.0)
    project = axes * spread

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                some = b.slice(at, AT_ONCE)
                x = _matrix(some["x"], dims)
                z = centre.centred(x) @ project
                listed = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([some["x"], some["weight"], pa.array(centre.deviations(x), pa.int64()), listed], names=["x", "weight", "deviation", "z"])

    done = written(distinct.mapInArrow(whitened, "x binary, weight long, deviation long, z array<double>"), "whitened")
    k = len(value)
    products, offset = _moments(done, lambda b: b["z"].flatten().to_numpy().reshape(-1, k), k)
    off = np.abs(products / centre.n - np.outer(offset, offset) / centre.n**2 - np.eye(k))[np.ix_(has, has)]
    error = float(off.max()) if has.any() else None
    explained = F.array(*[F.lit(None if trace is None else max(float(v), 0.0) / trace).cast("double") for v in value])

    back = rows.join(done, "x").select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return back.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
