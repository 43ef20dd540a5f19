"""Quality classifier: naive Bayes support vectors on n-grams.

The indicators of a text's hashed byte 2- and 3-grams, of 1- to 3-grams over whether a word repeats the
one before, and of the steps of its number of words and its share of repeats are scaled by their class log-count ratios, and
a linear hinge-loss model (L2-regularised, dual coordinate descent) is fitted on the scaled vectors of
length 1. A logistic curve fitted to margins out of fold turns margins into scores from 0 to 1.

The fit takes a bounded sample of the labelled rows (``sample``, a parameter): the rows with the
least hash of their id. Their distinct features (at most DIMS each) go to the driver; scoring is one
pass over the texts, in the tasks, with the weights sent along.

Defined cases: null text counts as empty; an empty text has no n-grams, only the steps for no word and no
repeat, and is scored by these. Labels that are null, or without a document, or for the held-out fold are not used; an id
with several labels takes their majority (a tie: 1). An id may have several texts: their distinct features all count, up to
``sample`` in the whole. Without labels of both
classes every score is the share of label 1 (0.5 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.words import Words, flat, inside, mix, row_blocks

DIMS = 1 << 17
SHAPES = 38
SAMPLE = 3000
FOLDS = 5
THRESHOLD = 0.3


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def feature_rows(col: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text, sorted: hashed byte 2- and 3-grams, and SHAPES for its words."""
    data, offs = flat(col)
    shapes = word_shapes(col)
    wide = data.astype(np.uint64)
    two = wide[:-1] * np.uint64(256) + wide[1:]
    three = two[:-1] * np.uint64(256) + wide[2:]
    two = (mix(two) % np.uint64(DIMS - SHAPES)).astype(np.int32)
    three = (mix(three + np.uint64(1 << 32)) % np.uint64(DIMS - SHAPES)).astype(np.int32)
    seen = np.zeros(DIMS, bool)
    for a, b, shape in zip(offs[:-1].tolist(), offs[1:].tolist(), shapes, strict=True):
        seen[two[a : max(a, b - 1)]] = True
        seen[three[a : max(a, b - 2)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield np.append(found, DIMS - SHAPES + np.flatnonzero(shape))


def word_shapes(col: pa.Array) -> np.ndarray:
    """For each text SHAPES indicators: 14 of the 1- to 3-grams over "this word repeats the one before", 16 of
    the steps of the number of words (by powers of two), 8 of the share of repeats (by halves)."""
    words = Words(col)
    n = np.diff(words.first)
    h = words.hashes()
    same = np.zeros(len(words), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    out = np.zeros((len(n), SHAPES), bool)
    code = same
    for k in (1, 2, 3):
        at = (1 << k) - 2
        ok = inside(words, k)
        out[words.row[: len(ok)][ok], at + code[: len(ok)][ok]] = True
        code = code[:-1] * 2 + same[k:]
    repeats = np.bincount(words.row, same, minlength=len(n))
    out[np.arange(len(n)), 14 + np.minimum(15, np.ceil(np.log2(n + 1))).astype(int)] = True
    share = np.maximum(repeats, 0.5) / np.maximum(n, 1)
    out[np.arange(len(n)), 30 + np.clip(np.floor(-np.log2(share)), 0, 7).astype(int)] = True
    return out


def log_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of the smoothed share of each indicator among the rows of class 1, to that in class 0."""
    p, q = np.full(DIMS, alpha), np.full(DIMS, alpha)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: np.ndarray, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of the L1-loss support vector machine, by dual coordinate descent;
    ``c``: the bound of each row's dual variable."""
    w, a = np.zeros(DIMS + 1), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1 for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(a[i] - g / norm[i], 0.0), c[i])
            if step := (new - a[i]) * y[i]:
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(step))
                a[i] = new
        if moved < 1e-3:
            break
    return w


def scaled(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The values of a row's features: log-count ratios, to length 1."""
    v = r[x]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def fit_curve(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a m + b))), by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    v = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        v -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (v - [1, 0]))
    return max(float(v[0]), 1e-3), float(v[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """A model from distinct features and labels (0 or 1) of the training rows."""
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    y = np.where(labels > 0, 1, -1)

    def machine(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = log_ratios([rows[i] for i in at], y[at])
        share = np.where(y[at] > 0, (y[at] > 0).mean(), (y[at] <= 0).mean())
        return r, fit_hinge([rows[i] for i in at], [scaled(rows[i], r) for i in at], y[at], 1 / (2 * share))

    out = np.zeros(len(rows))
    for k in range(3):  # margins out of fold, for the curve
        test = np.arange(len(rows)) % 3 == k
        if len(set(y[~test].tolist())) < 2:
            return {"constant": float(labels.mean())}
        r, w = machine(np.flatnonzero(~test))
        out[test] = [w[rows[i]] @ scaled(rows[i], r) + w[-1] for i in np.flatnonzero(test)]
    r, w = machine(np.arange(len(rows)))
    a, b = fit_curve(out, y)
    return {"product": (w[:-1] * r).astype(np.float32), "square": (r * r).astype(np.float32), "bias": float(w[-1]), "a": a, "b": b}


def score_rows(col: pa.Array, model: dict) -> np.ndarray:
    """Scores of texts."""
    if "constant" in model:
        return np.full(len(col), model["constant"])
    m = np.full(len(col), model["bias"])
    for i, x in enumerate(feature_rows(col)):
        m[i] += float(model["product"][x].sum(dtype=float)) / max(float(np.sqrt(model["square"][x].sum(dtype=float))), 1e-12)
    return 1 / (1 + np.exp(-np.clip(model["a"] * m + model["b"], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled rows of ``docs`` outside the held-out fold, equal ones of an id taken once. Both the ids
    and the rows are bounded, so an id that repeats over much of the table brings no more than ``sample`` to the driver."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).alias("label")).where("doc_id is not null and label is not null")
    ids = ids.where(fold() != 0).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: ids and labels only

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in row_blocks(b, "text"):
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["label"], pa.array([x.astype(np.int32).tobytes() for x in feature_rows(rows["text"])], pa.binary())], names=["doc_id", "label", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    found = rows.mapInArrow(features, "doc_id long, label int, x binary").distinct()  # map-side first
    got = found.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(sample).collect()
    got = sorted((r["doc_id"], r["label"], bytes(r["x"])) for r in got)
    return fit([np.frombuffer(x, np.int32) for _, _, x in got], np.array([label for _, label, _ in got]))


def score(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``carry`` (doc_id among them), held_out, score and predicted of every row."""
    source = docs.select(*dict.fromkeys((*carry, "text")))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights, twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in row_blocks(b, "text"):
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in carry), pa.array(score_rows(rows["text"], sent.value), pa.float64())], names=[*carry, "score"])

    scored = source.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "score double"]))
    return scored.select(*carry, F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
