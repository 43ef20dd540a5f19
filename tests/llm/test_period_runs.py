import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from mixclust.llm.period_runs import collapse_runs, lyndon_lengths, runs_of, summary, tail_loop
from mixclust.llm.queries import QUERIES
from mixclust.llm.words import Words

from .conftest import SF, WORD, sentence


def brute_runs(w, least=24, times=3):
    """(start, length, period) of all runs, by comparing all words that are p apart."""
    out, n = [], len(w)
    spans = set()
    for p in range(1, n // times + 1):
        a = 0
        while a + p < n:
            b = a
            while b + p < n and w[b] == w[b + p]:
                b += 1
            length = b + p - a
            if b > a and length >= max(least, times * p) and not any((a, length, q) in spans for q in range(1, p)):
                out.append((a, length, p))
            if b > a:
                spans.add((a, length, p))
            a = max(b, a + 1) if b > a else a + 1
    # a stretch with period p that is part of a run of a smaller period dividing p is no run of its own
    return sorted((a, n, p) for a, n, p in out if not any(q < p and p % q == 0 and c <= a and a + n <= c + m for c, m, q in out))


def brute(doc, text):
    w = WORD.findall(text or "")
    if w and (found := tail_loop(doc, len(w))):
        a, p = found
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    dropped = {i for a, n, p in runs for i in range(a + p, a + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    one = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc, len(runs), *one, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_lyndon_lengths():
    rng = random.Random(3)
    for _ in range(300):
        parts = [[rng.randint(1, rng.choice((1, 2, 4))) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 3))]
        flat = [x for p in parts for x in [*p, 0]]
        names = sorted(set(flat))
        rank = np.array([names.index(x) for x in flat])
        expected = []
        for p in parts:
            for i in range(len(p)):
                best = 1
                for j in range(i + 1, len(p) + 1):
                    u = p[i:j]
                    if all(u < u[k:] for k in range(1, len(u))):
                        best = j - i
                expected.append(best)
            expected.append(1)
        assert lyndon_lengths(rank).tolist() == expected


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_texts(letters):
    rng = random.Random(letters)
    for case in range(60):
        texts = []
        for _ in range(4):
            w = []
            while len(w) < rng.randint(0, 220):
                unit = [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(1, 14))]
                w += unit * rng.randint(1, 5) + unit[: rng.randint(0, len(unit))]
                w += [rng.choice("xyz") for _ in range(rng.randint(0, 4))]
            texts.append(" ".join(w))
        words = Words(pa.array(texts))
        least = rng.choice((6, 12, 24))
        found = runs_of(words.hashes(), words, least, 3)
        expected = [(int(words.first[r]) + a, n, p) for r, t in enumerate(texts) for a, n, p in brute_runs(t.split(), least)]
        assert [tuple(x) for x in found.tolist()] == sorted(expected), (case, texts)


def test_loops_of_long_periods():
    rng = random.Random(8)
    rows = []
    for d in range(40):
        unit = sentence(rng, rng.randint(1, 90)).split()
        rows.append((d, f"{sentence(rng, rng.randint(0, 40))} {' '.join((unit * 5)[: rng.randint(20, 5 * len(unit) + 20)])} {sentence(rng, 30)}"))
    for d, t in rows:
        words = Words(pa.array([t]))
        assert [tuple(x) for x in runs_of(words.hashes(), words).tolist()] == brute_runs(t.split())


def test_rough_documents(rough, none):
    rows = [(r.doc_id, r.text) for r in rough.collect()]
    # the long text is checked by the query's test
    small = [(d, t) for d, t in rows if len(t or "") < 60_000]
    expected = sorted((brute(d, t) for d, t in small), key=repr)
    out = summary(collapse_runs(rough, tail_loop))
    assert [r for r in got(out) if r[0] not in (11, 12)] == [r for r in expected if r[0] not in (11, 12)]
    assert out.count() == len(rows) and summary(collapse_runs(none, tail_loop)).collect() == []


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "start " + "to be or not " * 9 + "to be end"), (2, None), (None, "x " * 30)], "doc_id long, text string")
    by = {r.doc_id: r for r in collapse_runs(docs).collect()}
    assert by[1].collapsed == "start to be or not end" and [tuple(x) for x in by[1].runs] == [(1, 38, 4)]
    assert by[2].collapsed == "" and by[2].runs == [] and by[None].collapsed == "x" and by[None].n_words == 30


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r.text or "").split()) < 3000]
    out = got(QUERIES["op11_periodic_runs"](spark, SF))
    ids = {d for d, _ in rows}
    assert [r for r in out if r[0] in ids] == sorted((brute(d, t) for d, t in rows), key=repr)
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
