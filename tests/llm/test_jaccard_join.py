import random

import numpy as np
import pytest

from mixclust.llm.jaccard_join import extension, jaccard_components, keys_of, needed
from mixclust.llm.queries import QUERIES

from .conftest import LOWER, SF, WORD, sentence


def shingles(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id) of each (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d) if s else d) for d, s in sets), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(rng, w, most):
    w = list(w)
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(w))
        if rng.random() < 0.4:
            w[k] = sentence(rng, 1) + "x"
        elif rng.random() < 0.5:
            del w[k]
        else:
            w.insert(k, rng.choice(w))
    return w


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(14):
        base = sentence(rng, rng.choice((8, 12, 30, 60, 140, 200, 700))).split()
        for _ in range(rng.randint(1, 12)):
            w = edited(rng, base, max(1, len(base) // 25))
            rows.append((len(rows), rng.choice((" ", "\n")).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    lines = [[sentence(rng, 9) for _ in range(3)] for _ in range(18)]  # texts of a template: hardly a token of one text alone
    for _ in range(60):
        rows.append((len(rows), "\n".join(x[rng.randrange(3) if rng.random() < 0.12 else 0] for x in lines)))
    rows += [(900 + i, "tiny text") for i in range(3)] + [(950, "tiny"), (951, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,rare,short", [(85, 8, 128), (85, 1, 10_000), (70, 2, 60)])
def test_against_brute_force(spark, percent, rare, short):
    rows = corpus(percent + rare)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard_components(df, percent, rare=rare, short=short)) == brute(rows, percent)


@pytest.mark.parametrize("percent", [85, 60, 80])
def test_pairs_at_the_threshold_share_a_key_and_pass_the_prefix(percent):
    rng = random.Random(percent)
    for _ in range(400):
        both = rng.randint(1, 150)
        room = both * 100 // percent - both  # the most tokens that only one of them has
        own = rng.randint(0, room)
        pool = rng.sample(range(1 << 60), both + room)
        a, b = pool[: both + own], pool[:both] + pool[both + own :]
        count = {t: rng.choice((2, 3, 9, 200)) for t in pool[:both]} | {t: rng.choice((1, 2, 9, 200)) for t in pool[both:]}
        keys = []
        for s in (a, b):
            s = np.sort(np.array(s, np.uint64))
            key, common = keys_of(s, np.array([count[t] for t in s.tolist()]), percent, 8, 40)
            keys.append(dict(zip(key.tolist(), common.tolist())))
        if sorted(a) != sorted(b):
            assert any(min(keys[0][k], keys[1][k]) >= both for k in keys[0].keys() & keys[1].keys())
        sizes = [np.int64(len(a)), np.int64(len(b))]
        prefix = [set(np.sort(np.array(s, np.uint64))[: int(min(n, n - needed(n, percent) + extension(n, percent)))].tolist()) for s, n in zip((a, b), sizes)]
        for n in sizes:
            assert len(prefix[0] & prefix[1]) >= extension(needed(n, percent), percent) or sorted(a) == sorted(b)


def test_rough_documents(rough, none):
    rows = [(r.doc_id, r.text) for r in rough.collect()]
    assert got(jaccard_components(rough)) == brute(rows)
    assert jaccard_components(none).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op13_jaccard_join"](spark, SF)) == brute(rows)
