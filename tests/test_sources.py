"""JSON scan and featurizer edge inputs (FIXTURES.md §2, §5), sinks and run comparison."""

import json

import pytest

from mixclust.operators.featurize import featurize_spam, split_valid
from mixclust.plans.job import read_conf, run_from_files, run_job
from mixclust.plans.params import PARAMETER_KEYS, ClusterParams
from mixclust.session import fresh_dir
from mixclust.sources.json_lines import read_json_lines
from mixclust.sources.runlog import compare_runs, read_run_logs

from .conftest import DATA, SPAM_WEIGHTS


def test_featurize_edges(spark, tmp_path):
    lines = [
        "{}",
        '{"_id": {"$oid": "a"}, "bot": "", "uri": ["a,b", "c"], "size": "12", "IP": "1.2.3.4"}',
        '{"_id": {"$oid": "b"}, "bot": null, "uri": [], "date": {"$date": 5}}',
        '{"_id": {"$oid": "c"}, "IP": "fe80::1"}',
        '{"_id": {"$oid": "d"}, "IP": "", "size": 3}',
        '{"_id": {"$oid": "e"}, "size": "NaN"}',
        '{"_id": {"$oid": "f"}, "lat": "-Infinity"}',
        "",
        "   ",
        "null",
        "not json at all",
    ]
    p = tmp_path / "edge.jsonl"
    p.write_text("\n".join(lines) + "\n")
    good, bad = read_json_lines(spark, str(p))
    assert [r._corrupt_record for r in bad.collect()] == ["null", "not json at all"]
    rows = {r.id: r for r in featurize_spam(good).collect()}
    empty = rows["0"]
    assert (empty.time, empty.size, empty.long, empty.lat, empty.ip, empty.bot, empty.uri) == (0.0, 0.0, 0.0, 0.0, 0.0, "_", "_")
    a = rows["a"]
    assert (a.bot, a.uri, a.size, a.ip) == ("0.0", "a", 12.0, 16909060.0)
    b = rows["b"]
    assert (b.bot, b.uri, b.time) == ("_", "", 5.0)
    ok, rejected = split_valid(featurize_spam(good), ["time", "size", "long", "lat", "ip"])
    assert [r.id for r in rejected.collect()] == ["c", "e", "f"]
    assert {r.id: r.ip for r in ok.collect()}["d"] == 0.0
    assert ok.count() + rejected.count() + bad.count() == 9  # every line that is not blank


def test_job_outputs_and_run_compare(spark):
    out = fresh_dir(spark, "runs-test")
    for mode, label in (("PartialSums", "ps"), ("Standard", "st")):
        p = ClusterParams(mode=mode, k=3, epsilon=0.001, max_iter=2, samples_for_medoid=1, weights=SPAM_WEIGHTS)
        r = run_job(spark, f"{DATA}/spam10.jsonl", p, out_root=out, label=label)
        assert r.report[0].startswith("Begin QUALITY") and "Num\t->\tAvg Radius" in r.report
        assert len(r.centroids) <= 3
    cmp = {row.trial.split("_")[0]: row for row in compare_runs(read_run_logs(spark, f"{out}/log")).collect()}
    assert set(cmp) == {"ps", "st"}
    for row in cmp.values():
        assert row.num_points == 10 and row.num_centroids == 3 and row.total_seconds > 0
    params = spark.read.json(f"{out}/params").collect()
    assert {json.loads(r.params)["mode"] for r in params} == {"PartialSums", "Standard"}
    assert spark.read.parquet(f"{out}/centroids").select("run_label").distinct().count() == 2


LOG = """Job finished: a, took {seconds} s
noise
Begin QUALITY ----
Num of centroids:\t{k}
Num of points:\t\t10
Num of Iteration:\t2
Inter Avg Distance\t0.250000
Intra Avg Distance:\t0.125000
Num\t->\tAvg Radius
Num of centroids:\t99
End QUALITY ----
"""


def test_run_compare_keeps_runs_apart(spark, tmp_path):
    folder = tmp_path / "trial1"
    folder.mkdir()
    (folder / "a.log").write_text(LOG.format(seconds="5.0E-4", k=3))
    (folder / "b.log").write_text(LOG.format(seconds="2.5", k=4) + "Job finished: b, took 1 s\n")
    rows = sorted(compare_runs(read_run_logs(spark, str(tmp_path / "*"))).collect(), key=lambda r: r.num_centroids)
    assert [(r.trial, r.num_centroids, r.total_seconds) for r in rows] == [("trial1", 3, 5.0e-4), ("trial1", 4, 3.5)]


def test_job_from_configuration_files(spark, tmp_path):
    conf = {"host": "local", "inputFile": f"{DATA}/spam10.jsonl", "appName": "trial", "evalOutput": "1"}
    params = {"mode": "Standard", "initialCentroids": 3, "convergeDist": 0.001, "maxIter": 2, "numSamplesForMedoid": 1, "weights": SPAM_WEIGHTS}
    (tmp_path / "job.json").write_text(json.dumps(conf))
    (tmp_path / "params.json").write_text(json.dumps(params))
    res = run_from_files(spark, str(tmp_path / "out"), str(tmp_path / "job.json"), str(tmp_path / "params.json"))
    assert res.quality is not None and len(res.centroids) == 3
    del conf["evalOutput"]
    (tmp_path / "job.json").write_text(json.dumps(conf))
    with pytest.raises(ValueError, match="job configuration.*evalOutput"):
        run_from_files(spark, str(tmp_path / "out"), str(tmp_path / "job.json"), str(tmp_path / "params.json"))
    (tmp_path / "params.json").write_text(json.dumps({"mode": "Standard"}))
    with pytest.raises(ValueError, match="parameter file.*initialCentroids"):
        read_conf(spark, str(tmp_path / "params.json"), PARAMETER_KEYS, "parameter file")
