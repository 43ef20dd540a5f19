"""FIXTURES.md §4: ten invented records, every mode, against the plain Python clustering."""

import os

import pytest

from mixclust.operators.evaluate import evaluate
from mixclust.plans.geometry import Geometry, literals
from mixclust.plans.job import run_job
from mixclust.plans.kmeans import kmeans_mixed
from mixclust.plans.params import SPAM_FEATURES, ClusterParams

from .conftest import DATA, SPAM_WEIGHTS
from .plain import Plain

CASES = [("Standard", 1, 2), ("Standard", 3, 20), ("Standard", 0, 20), ("PartialSums", 1, 2), ("PartialSums", 1, 20)]


def plain(m):
    w = SPAM_WEIGHTS
    return Plain([(["time"], w["time"]), (["size"], w["size"]), (["long", "lat"], w["space"]), (["ip"], w["IP"])],
                 [("bot", w["botname"]), ("uri", w["uri"])], m)


def seeds_of(rows):
    return [{k: v for k, v in dict(rows[i], cluster_id=j).items() if k != "id"} for j, i in enumerate([0, 2, 4])]


def test_limits_and_scaled_row(spam):
    _, lim, rows = spam
    assert lim["time"] == (1700000000000.0, 1700000098000.0)
    assert lim["size"] == (1100.0, 5200.0)
    assert lim["long"] == (-71.5, 103.8) and lim["lat"] == (-34.9, 43.0)
    assert lim["ip"] == (167838211.0, 3405803785.0)
    r0 = rows[0]
    assert [round(r0[c], 6) for c in ("time", "size", "long", "lat", "ip")] == [0.0, 0.02439, 0.479179, 0.985879, 0.0]
    assert (r0["bot"], r0["uri"], rows[7]["bot"], rows[9]["uri"]) == ("Alpha", "http://first.example/x", "0.0", "")


def test_element_distances(spark, spam):
    _, _, rows = spam
    for m in (1, 0):
        g = Geometry(SPAM_FEATURES, SPAM_WEIGHTS, m)
        for b in (1, 2, 7):
            got = spark.range(1).select(g.distance(literals(rows[0]), literals(rows[b])).alias("d")).first()["d"]
            assert got == pytest.approx(plain(m).distance(rows[0], rows[b]), abs=1e-12)


@pytest.mark.parametrize("plan", ["inline", "dictionary"])
@pytest.mark.parametrize("mode,m,max_iter", CASES)
def test_runs(spam, plan, mode, m, max_iter):
    pts, _, rows = spam
    geom = Geometry(SPAM_FEATURES, SPAM_WEIGHTS, m)
    res = kmeans_mixed(pts, seeds_of(rows), geom, mode, 0.001, max_iter, plan=plan)
    expected, stops = plain(m).run(rows, seeds_of(rows), mode, 0.001, max_iter)
    assert res.iterations == stops
    assert [c["cluster_id"] for c in res.centroids] == sorted(expected)
    for c in res.centroids:
        for name, value in expected[c["cluster_id"]].items():
            assert c[name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value)
    inter, intra, stats = plain(m).quality(rows, expected)
    q = evaluate(pts, res.centroids, geom, res.iterations)
    row = q.quality.first()
    assert (row.num_centroids, row.num_points, row.num_iterations) == (len(expected), 10, stops)
    assert row.inter_avg_distance == pytest.approx(inter) and row.intra_avg_distance == pytest.approx(intra)
    assert {r.cluster_id: (r.n, pytest.approx(r.radius)) for r in q.stats.collect()} == stats


def test_whole_job_from_start_rows(spark, spam):
    _, lim, rows = spam
    un = lambda r: {c: r[c] * (lim[c][1] - lim[c][0]) + lim[c][0] if c in lim else r[c] for c in r}
    p = ClusterParams(mode="Standard", k=3, epsilon=0.001, max_iter=20, samples_for_medoid=3, weights=SPAM_WEIGHTS)
    res = run_job(spark, os.path.join(DATA, "spam10.jsonl"), p, init=[un(rows[i]) for i in (0, 2, 4)])
    expected, stops = plain(3).run(rows, seeds_of(rows), "Standard", 0.001, 20)
    assert res.result.iterations == stops and res.rejects.count() == 0
    for c in res.centroids:
        e = un(expected[c["cluster_id"]])
        assert c["bot"] == e["bot"] and c["long"] == pytest.approx(e["long"]) and c["time"] == pytest.approx(e["time"])
    got = {r.id: r.cluster_id for r in res.assignments.collect()}
    assert got == {p["id"]: -plain(3).nearest(p, expected)[1] for p in rows}
