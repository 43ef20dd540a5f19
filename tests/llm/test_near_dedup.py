import random

import numpy as np
import pyarrow as pa
import pytest

from mixclust.llm.components import components
from mixclust.llm.near_dedup import near_components
from mixclust.llm.queries import QUERIES
from mixclust.llm.setsketch import REGISTERS, margin, shingle_sets, similarity, sketches
from mixclust.llm.words import Words

from .conftest import LOWER, SF, WORD, sentence


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    """(doc_id, n_shingles, component_id, kept) of each (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    out = []
    for d, s in sets:
        c = None if d is None else find(d) if s else d
        out.append((d, len(s), c, d is None or d == c))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_registers_merge_and_estimate():
    rng = random.Random(1)
    a, b = [sentence(rng, 1) + str(i) for i in range(900)], [sentence(rng, 1) + "z" + str(i) for i in range(100)]
    texts = [" ".join(a), " ".join(a[:800] + b), " ".join(a[:400]), " ".join(a[400:])]
    value, offs = shingle_sets(Words(pa.array(texts)), 1)
    s, n = sketches(value, offs), np.diff(offs).astype(float)
    assert (np.maximum(s[2], s[3]) == s[0]).all()  # the union's registers
    near = similarity(s[[0]], s[[1]], n[[0]], n[[1]])[0]
    assert abs(near - 800 / 1000) < 5 * (0.8 * 0.2 / REGISTERS) ** 0.5
    assert similarity(s[[0]], s[[0]], n[[0]], n[[0]])[0] > 0.97


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_against_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    rows = []
    for g in range(12):
        base = sentence(rng, rng.randint(40, 120)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append((len(rows), rng.choice((" ", "\n")).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rows += [(500 + i, "tiny text") for i in range(3)] + [(600, "tiny"), (601, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(near_components(df, threshold)) == brute(rows, round(threshold * 100))


def test_rough_documents(rough, none):
    rows = [(r.doc_id, r.text) for r in rough.collect()]
    assert got(near_components(rough)) == brute(rows, 85)
    assert near_components(none).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op4_near_dedup"](spark, SF)) == brute(rows, 85)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 230)] + [(1, 1), (None, 3), (7, 160)]
    out = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(out.values()) == {1, 7} and len(out) == 61 + 30 + 2
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("threshold,both,own", [(0.85, 170, 15), (0.8, 160, 20)])
def test_pairs_at_the_threshold_are_within_the_margin(threshold, both, own):
    rng = np.random.default_rng(2)
    pairs, size = 4000, both + own
    a = rng.integers(0, 1 << 63, (pairs, size)).astype(np.uint64)
    b = a.copy()
    b[:, :own] = rng.integers(0, 1 << 63, (pairs, own)).astype(np.uint64)
    offs, n = np.arange(pairs + 1) * size, np.full(pairs, float(size))
    estimate = similarity(sketches(a.ravel(), offs), sketches(b.ravel(), offs), n, n)
    assert (estimate < threshold - 0.09).any() and (estimate >= threshold - margin(threshold)).all()
