import zlib

import numpy as np
import pyarrow as pa
import pytest

from mixclust.llm import quality
from mixclust.llm.quality import DIMS, feature_rows, fit, learn, score, score_rows
from mixclust.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_folds(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_quality"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [x for x in labels if x.doc_id in rows and rows[x.doc_id].held_out]
    right = [rows[x.doc_id].predicted == x.quality for x in held]
    assert len(held) > 40 and np.mean(right) >= 0.93


def test_features_are_distinct_and_whole():
    (a, b, c) = feature_rows(pa.array(["ab ab ab", None, "x" * 100_000 + "yz"]))
    for x in (a, b, c):
        assert len(set(x.tolist())) == len(x) and x.max() < DIMS
    (d,) = feature_rows(pa.array(["x" * 100_000]))
    assert set(c.tolist()) - set(d.tolist())  # the end of a long text counts


def test_rough_documents(spark, rough, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, None), (3, None, 1), (4, 0, 0), (5, 0, 0), (None, 1, 1), (16, 0, 1), (17, 0, 1), (99, 1, 0), (14, 1, 0), (18, 0, 0), (13, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = learn(rough, labels)
    out = score(rough, model, carry=("doc_id", "text", "label")).collect()
    assert len(out) == rough.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1  # null and empty alike
    assert score(none, model).collect() == []
    assert learn(none, labels) == {"constant": 0.5}
    one = learn(rough, labels.where("quality = 1"))
    assert one == {"constant": 1.0} and {r.predicted for r in score(rough, one).collect()} == {1}


def test_labels_of_the_held_out_fold_are_not_used(spark, rough):
    ids = [d for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 0][:6]
    docs = spark.createDataFrame([(d, f"text {d}") for d in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, quality int")
    assert learn(docs, labels) == {"constant": 0.5}


def test_machine_separates_and_orders():
    good, bad = [f"fine words number {i} here" for i in range(60)], [f"bad!!! stuff$$$ {i} %%%" for i in range(30)]
    rows = list(feature_rows(pa.array(good + bad)))
    model = fit(rows, np.array([1] * 60 + [0] * 30))
    s = score_rows(pa.array(["fine words again here", "bad!!! more$$$ %%%"]), model)
    assert s[0] > 0.7 > 0.3 > s[1]
    with pytest.raises(KeyError):
        model["constant"]


def test_an_id_that_repeats_over_a_third_of_the_rows_is_bounded(spark, monkeypatch):
    hot = next(d for d in range(1000, 1100) if zlib.crc32(str(d).encode()) % 5)
    docs = spark.range(900).selectExpr(f"CASE WHEN id % 3 = 0 THEN {hot} ELSE id END AS doc_id",
                                       "CASE WHEN id % 6 = 0 THEN 'one text' ELSE concat('text ', id) END AS text")
    labels = spark.createDataFrame([(d, d % 2) for d in [hot, *range(1, 900, 40)]], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: seen.append(len(rows)) or {"constant": 0.5})
    learn(docs, labels, sample=40)
    learn(docs, labels, sample=3000)
    learn(docs.repartition(7), labels, sample=40)
    assert seen[0] == seen[2] == 40
    assert 100 < seen[1] < 200  # 150 texts of the hot id and the one that repeats, not 300
