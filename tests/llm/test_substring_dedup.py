import hashlib
import random

import pytest

from mixclust.llm.queries import QUERIES
from mixclust.llm.substring_dedup import cut_repeats, levels

from .conftest import SF, WORD, sentence


def brute(rows, n):
    """(n_words, n_removed, kept) of each (doc_id, text)."""
    first, out = {}, []
    for doc, text in rows:
        w = WORD.findall(text or "")
        if doc is not None:
            for i in range(len(w) - n + 1):
                first[tuple(w[i : i + n])] = min(doc, first.get(tuple(w[i : i + n]), doc))
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[i : i + n])] < doc:
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def test_levels_double_up_to_the_length():
    assert levels(50, 25) == [25, 50] and levels(50, 10) == [7, 13, 25, 50] and levels(5, 25) == [5]


@pytest.mark.parametrize("least,first", [(6, 3), (7, 7), (9, 2)])
def test_against_brute_force(spark, least, first):
    rng = random.Random(least)
    passages = [sentence(rng, rng.randint(4, 30)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else sentence(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 90), rng.choice((" ", "\n", "  \t")).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(cut_repeats(df, least, first)) == brute(rows, least)


def test_rough_documents(rough, none):
    rows = [(r.doc_id, r.text) for r in rough.collect()]
    assert got(cut_repeats(rough)) == brute(rows, 50)
    assert cut_repeats(none).collect() == []


def test_no_candidate_survives(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert got(cut_repeats(df)) == [(1, 3, 0, "a b c"), (2, 3, 0, "a b c")]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows, 50)]
    assert sorted(map(tuple, QUERIES["op1_substring_dedup"](spark, SF).collect()), key=repr) == sorted(expected, key=repr)
