"""The pipeline's stages: planted cases, rough documents, and each stage against its operator's brute force."""

import hashlib

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from mixclust.llm.sentencepiece_bpe import default_model
from mixclust.session import written

from .test_decontaminate import brute as brute_leaks
from .test_near_dedup import brute as brute_near
from .test_substring_dedup import brute as brute_cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "stage"))
    return out


def test_order_and_columns(stages):
    assert [n.split()[0] for n, _ in pipeline.STAGES] == ["quality", "MinHash", "substring", "benchmark", "SentencePiece"]
    assert all(tuple(df.columns) == pipeline.COLUMNS for df in stages[:-1])
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_good_documents_stay(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    here = {r.doc_id for r in stages[0].collect()}
    good, bad = ([d for d, q in labels.items() if q == want and d in here] for want in (1, 0))
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.4 * len(bad)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {d for d, _, _, kept in brute_near(rows, 80) if kept}


def test_repeats_are_cut_and_the_rest_is_untouched(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    expected = {d: (gone, kept) for d, _, gone, kept in brute_cut([(d, r.text) for d, r in before.items()], 50)}
    for r in stages[3].collect():
        gone, kept = expected[r.doc_id]
        assert r.text == (kept if gone else before[r.doc_id].text)
        assert r.n_chars == (len(kept) if gone else before[r.doc_id].n_chars)


def test_different_texts_of_one_id_stay(spark):
    a, b, c = ("alpha beta gamma delta epsilon " * 6 + x for x in ("one", "two three four five six seven eight nine ten eleven twelve", "x"))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, a, "en", "s", 1), (7, base, "en", "s", 2), (3, base + " end", "en", "t", 3), (9, b, None, None, None), (9, b, "de", None, 5), (9, None, "xx", None, 0), (9, None, "yy", None, 0), (None, base, "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = sorted(map(tuple, pipeline.keep_one_of_near_copies(spark, docs, SF).collect()), key=repr)
    expected = [(7, a, "en", "s", 1), (3, base + " end", "en", "t", 3), (9, b, None, None, None), (9, None, "xx", None, 0), (None, base, "en", "s", 4)]
    assert out == sorted(expected, key=repr)


def test_leaks_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    assert {r.doc_id for r in stages[4].collect()} == {d for d, _ in rows} - {x[0] for x in brute_leaks(rows, items)}


def test_ids_are_the_librarys(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    text = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        ids = library.encode(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rough_and_empty_documents_go_through(spark, rough, none):
    for docs in (rough, none):
        for _, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "stage")
    ids = [r.doc_id for r in docs.collect()]
    assert ids == []
    docs = rough
    for _, stage in pipeline.STAGES[1:]:
        docs = written(stage(spark, docs, SF), "stage")
    rows = docs.collect()
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert sorted(known + [13]) == sorted([*set(known), 13, 13]) and {1, 4, 5, 6, 7, 11, 13, 15, 16, 17} <= set(known)
    assert not {2, 12, 14} & set(known) and sum(r.doc_id is None for r in rows) == 2
