import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixclust.llm.set_links import _tiles, cross_links, linkable, links_in_tile, with_counts


def groups(rng, sizes, alike, n=200):
    """Sets of each group, of which two share about ``alike`` (Jaccard), by replaced elements of their own."""
    out = []
    for m in sizes:
        base = [rng.getrandbits(64) for _ in range(n)]
        own = round(n * (1 - 2 * alike / (1 + alike)))
        for _ in range(m):
            s = list(base)
            for i in rng.sample(range(n), own):
                s[i] = rng.getrandbits(64)
            out.append(frozenset(s))
    return out


def variants(rng, m, slots=40, width=5, kinds=2):
    """Sets that differ in which of a few variants each slot has: no element is of one set alone."""
    pool = [[[rng.getrandbits(64) for _ in range(width)] for _ in range(kinds)] for _ in range(slots)]
    return [frozenset(x for s in pool for x in s[rng.randrange(kinds) if rng.random() < 0.25 else 0]) for _ in range(m)]


def classes(sets, links):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(sets))]


def brute(sets, percent):
    return classes(sets, [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(x & y) >= percent * len(x | y)])


def packed(s):
    return np.sort(np.array(list(s), np.uint64)).tobytes()


def tables(spark, sets, keys):
    s = spark.createDataFrame([(i, 7 * i, bytearray(packed(x))) for i, x in enumerate(sets)], "d long, k long, shingles binary").repartition(5)
    m = spark.createDataFrame([(key, i, 7 * i, i) for key, own in keys.items() for i in own], "key long, doc long, h long, component long")
    return m, s


def cross(m, s, percent):
    sets = linkable(s, percent)
    return cross_links(m.join(sets.select(F.col("d").alias("doc"), "n", "most"), "doc"), sets, percent)


@pytest.mark.parametrize("percent", [85, 80])
def test_cross_links_against_brute_force(spark, percent):
    rng = random.Random(percent)
    sets = groups(rng, (9, 5), 0.9) + groups(rng, (8, 30), 0.83) + groups(rng, (20,), 0.78) + variants(rng, 60) + groups(rng, (3, 2), 0.95, 2000)
    keys = {1: range(len(sets)), 2: range(0, len(sets), 2), 3: range(0, len(sets), 2), 4: [1], 5: []}
    m, s = tables(spark, sets, keys)
    links = [(r.a, r.b) for r in cross(m, s, percent).collect()]
    assert classes(sets, links) == brute(sets, percent)
    assert all(100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a, b in links)


@pytest.mark.parametrize("alike", [0.70, 0.76, 0.84, 0.90])
def test_links_grow_with_the_sets_not_their_pairs(spark, alike):
    rng = random.Random(1)
    found = {}
    for m in (150, 300):
        sets = groups(rng, (m,), alike, 150)
        members, s = tables(spark, sets, {1: range(m)})
        links = [(r.a, r.b) for r in cross(members, s, 85).collect()]
        assert classes(sets, links) == brute(sets, 85)
        found[m] = len(links)
    assert found[300] < 300 and found[300] <= 2.2 * found[150] + 10


def test_tiles_in_pieces():
    rng = random.Random(5)
    sets = groups(rng, (12, 30), 0.92, 60)
    rows = sorted((i % 3, 0, 0, 0, i, i, 10**6, packed(x)) for i, x in enumerate(sets))
    whole = pa.record_batch([pa.array([r[c] for r in rows], pa.binary() if c == 7 else pa.int64()) for c in range(8)], names=["key", "ti", "tj", "part", "doc", "component", "most", "shingles"])
    expected = None
    for step in (100, 1, 4, 7):
        out = [x for b in _tiles(85)(whole.slice(a, step) for a in range(0, len(rows), step)) for x in zip(b["a"].to_pylist(), b["b"].to_pylist())]
        got = classes(sets, out)
        expected = expected or got
        assert got == expected and len(out) == len(sets) - 6


def test_parts_of_a_tile():
    rng = random.Random(6)
    sets = groups(rng, (40,), 0.93, 80)
    elements = np.concatenate([np.frombuffer(packed(x), np.uint64) for x in sets])
    offs = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    part, doc = np.arange(40) % 2, np.arange(40)
    links = links_in_tile(part, False, doc, doc, np.full(40, 10**6), elements, offs, 85)
    assert links and all(part[a] != part[b] for a, b in links)


def test_counts(spark):
    rng = random.Random(7)
    pool = [rng.getrandbits(64) for _ in range(300)]
    sets = [frozenset([pool[0], *rng.sample(pool, rng.randint(0, 40))]) for _ in range(300)] + [frozenset()]
    _, s = tables(spark, sets, {})

    def use(own, elements, offs, count):
        return pa.table({"d": own["d"], "c": pa.array([x.astype(np.int64).tobytes() for x in np.split(count, offs[1:-1])], pa.binary())})

    got = {r.d: np.frombuffer(r.c, np.int64).tolist() for r in with_counts(s, use, "d long, c binary").collect()}
    assert got == {i: [min(255, sum(e in y for y in sets)) for e in sorted(x)] for i, x in enumerate(sets)}
    assert with_counts(s.where("false"), use, "d long, c binary").collect() == []
