import math
import random

import numpy as np
import pytest

from mixclust.llm.queries import QUERIES
from mixclust.llm.whitening import Centre, whiten

from .conftest import SF


def brute(rows, weights="one", components=16):
    """{repr of (vec_id, x): (n, deviation, |whitened|..., explained...)} of each (vec_id, vector)."""
    ok = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in ok)
    ok = [(i, tuple(x + [1_000_000] * (dims - len(x)))) for i, x in ok]
    fit = {}
    for _, x in ok:
        fit[x] = fit.get(x, 0) + 1 if weights == "count" else 1
    n = sum(fit.values())
    sums = [sum(w * x[d] for x, w in fit.items()) for d in range(dims)]
    c = np.array([[(n * x[d] - sums[d]) / n for d in range(dims)] for x in fit])
    w = np.array(list(fit.values()), float)
    value, axes = np.linalg.eigh((c * w[:, None]).T @ c / n)
    value, axes = value[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for i, x in ok:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        z = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ axes / np.sqrt(value)
        out.append((i, n, dev, z, value / np.trace((c * w[:, None]).T @ c / n)))
    return out


def same(df, expected):
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    errors = {r.identity_error for g in got.values() for rs in g.values() for r in rs}
    assert len(errors) == 1 and errors.pop() < 1e-6
    want = {}
    for i, n, dev, z, explained in expected:
        want.setdefault((i, dev), []).append((n, z, explained))
    assert set(want) == set(got)
    sign = None
    for k, rows in want.items():
        n, z, explained = rows[0]
        assert sorted(got[k]) == list(range(1, len(z) + 1))
        mine = np.array([got[k][c + 1][0].whitened for c in range(len(z))])
        if sign is None and (np.abs(z) > 0.05).all():
            sign = np.sign(z) * np.sign(mine)
        assert np.allclose(np.abs(mine), np.abs(z), atol=1e-6)
        for c in range(len(z)):
            assert len(got[k][c + 1]) == len(rows)
            assert got[k][c + 1][0].n == n and got[k][c + 1][0].explained == pytest.approx(explained[c], rel=1e-6)
    return sign, got


def vectors(rng, n, dims=6):
    return [(i, [rng.gauss(0, 1 + d) * (0.1 if d % 2 else 1) for d in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_brute_force(spark, weights):
    rng = random.Random(2)
    rows = vectors(rng, 300)
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1]), (8, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    out = whiten(df, weights=weights)
    sign, got = same(out, brute(rows, weights))
    for i, n, dev, z, _ in brute(rows, weights):  # one sign for all rows
        mine = np.array([got[(i, dev)][c + 1][0].whitened for c in range(len(z))])
        assert np.allclose(mine, z * sign, atol=1e-6)


def test_rough_vectors(spark):
    rng = random.Random(4)
    rows = [(i, v, "x", None if i % 2 else "y") for i, v in vectors(rng, 60)]
    odd = [(100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, [1.0, 2.0]), (105, []), (None, [0.5] * 6), (7, [0.25] * 6), (7, [0.25] * 6)]
    rows += [(i, v, None, "n") for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n string").repartition(3)
    same(whiten(df), brute([(r.vec_id, r.embedding) for r in df.collect()]))
    assert whiten(df.where("false")).collect() == [] and whiten(df.where("embedding is null")).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 2.0]), (3, [2.0, 2.5]), (4, [3.0, 1.5])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whiten(huge).collect()} == {2, 3, 4}


def test_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    rows = whiten(one).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(v, c, 1, 0, 0.0, None, None) for v in (1, 2) for c in (1, 2)}
    flat = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whiten(flat).collect()}
    assert all(got[(i, 2)].whitened == 0.0 and got[(i, 2)].explained == 0.0 and got[(i, 1)].identity_error < 1e-9 for i in range(5))


def test_exact_deviations():
    x = np.array([[5, 2**40], [7, -(2**40)], [9, 3]])
    centre = Centre(3, [21, 3])
    assert centre.deviations(x) == [(15 - 21) ** 2 + (3 * 2**40 - 3) ** 2 if (3 * 2**40) ** 2 < 2**63 else None, None, (27 - 21) ** 2 + (9 - 3) ** 2]
    small = np.array([[5, 1], [7, 2], [9, 3]])
    assert Centre(3, [21, 6]).deviations(small) == [36 + 9, 0, 36 + 9]


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = QUERIES["op12_whitening"](spark, SF)
    assert out.count() == 16 * len([v for _, v in rows if v is not None])
    same(out, brute(rows))
