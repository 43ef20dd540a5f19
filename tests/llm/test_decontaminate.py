import random
from collections import Counter

import numpy as np
import pytest

from mixclust.llm.decontaminate import BLOCKS, RADIUS, build_index, clean, fingerprints, item_blocks, leaks, within_radius
from mixclust.llm.queries import QUERIES

from .conftest import LOWER, SF, WORD, sentence


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(w):
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, items, least=0.8):
    items = [(i, words(t)) for i, t in items if words(t)]
    holds = Counter(s for _, w in items for s in shingles(w))
    weight = lambda some: sum(1 / holds[s] if s in holds else 1 for s in some)
    out = []
    for doc, text in rows:
        w = words(text)
        here = {s for n in {min(5, len(own)) for _, own in items} for s in (tuple(w[i : i + n]) for i in range(len(w) - n + 1))}
        for item, own in items:
            best = None
            if here.isdisjoint(shingles(own)):
                continue
            for k in range(len(w) - len(own) + 1):
                x, y = shingles(w[k : k + len(own)]), shingles(own)
                if x & y:
                    both = weight(x & y)
                    alike = both / (weight(x) + weight(y) - both)
                    if alike >= least - 1e-9:
                        best = max(best or (0, 0), (round(alike, 9), -k))
            if best:
                out.append((doc, item, -best[1], len(own), best[0]))
    return sorted(out, key=repr)


def case(seed=3):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randint(15, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "one two three")]
    items.append((93, items[0][1] + " " + sentence(rng, 2)))
    rows = []
    for d in range(60):
        parts = [sentence(rng, rng.randint(0, 50))]
        if d % 3 == 0:
            w = words(rng.choice(items[:25])[1])
            if d % 2:
                w[-1] = "other"
            parts.append(rng.choice((" ", "\n")).join(w).upper())
        if d % 20 == 7:
            parts.append("One TWO three")
        rows.append((d, " ".join([*parts, sentence(rng, rng.randint(0, 20))])))
    return rows, items


@pytest.mark.parametrize("block", [20_000, 7])
def test_against_brute_force(spark, block):
    rows, items = case()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, leaks(docs, bench, block=block).collect()), key=repr)
    if block == 20_000:  # weights are those of the items of a block
        assert got == brute(rows, items)
    bad = {g[0] for g in brute(rows, items)}
    assert bad and {g[0] for g in got} == bad
    assert {r.doc_id for r in clean(docs, bench, block=block).collect()} == {d for d, _ in rows} - bad


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    _, items = case()
    size = max(build_index([(i, t or "") for i, t in items], 0.8).sizes, key=lambda s: len(s.items))
    prints = []
    for p in size.prints:
        for flips in (0, 5, RADIUS, RADIUS + 1):
            bits = np.unpackbits(p.astype("<u2").view(np.uint8), bitorder="little")
            bits[rng.permutation(len(bits))[:flips]] ^= 1
            prints.append(np.packbits(bits, bitorder="little").view("<u2").astype(np.int64))
    prints = np.array(prints)
    w, i = within_radius(size, prints)
    far = np.bitwise_count(prints[:, None] ^ size.prints[None]).sum(2)
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= RADIUS))))
    assert prints.shape[1] == BLOCKS


def test_many_items_of_one_size_probe_by_value():
    rng = random.Random(2)
    items = [(i, sentence(rng, 20)) for i in range(800)]
    (size,) = build_index(items, 0.8).sizes
    w, i = within_radius(size, size.prints[:50])
    assert {(k, k) for k in range(50)} <= set(zip(w.tolist(), i.tolist()))


def test_rough_documents(spark, rough, none):
    long_text = next(r.text for r in rough.where("doc_id = 11").collect())
    part = " ".join(long_text.split()[15_000:15_030])
    bench = spark.createDataFrame([(1, part), (None, part), (2, None)], "item_id long, text string")
    bench = bench.union(spark.createDataFrame([(-1, part), (1, part)], bench.schema))  # a repeated row, and an id that is no null
    found = [(r.doc_id, r.item_id, r.first_word) for r in leaks(rough, bench).collect()]
    assert sorted(found, key=repr) == sorted([(d, i, 15_000) for d in (11, 12) for i in (1, None, -1)], key=repr)
    left = clean(rough, bench)
    assert left.columns == rough.columns and left.count() == rough.count() - 2
    assert clean(rough, bench.where("false")).count() == rough.count()
    assert leaks(none, bench).collect() == [] and clean(none, bench).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op2_decontaminate"](spark, SF).collect()), key=repr) == brute(rows, items)


def changed(text, n):
    """The text with its last n words changed: as many shingles."""
    w = words(text)
    return " ".join([*w[: len(w) - n], *(f"other{k}" for k in range(n))])


@pytest.mark.parametrize("copies", [1, 2, 10])
def test_near_copies_of_repeated_and_templated_items(spark, copies):
    rng = random.Random(8)
    long, short, template = sentence(rng, 59), sentence(rng, 24), sentence(rng, 40)
    items = [(i, x) for k, x in enumerate((long, short)) for i in range(100 * k, 100 * k + copies)]
    items += [(200 + i, f"{template} tail{i}") for i in range(copies)]
    rows = [(0, changed(long, 5)), (1, changed(short, 1)), (2, "new " + " ".join(template.split()[1:]) + " tail0"), (3, changed(long, 20))]
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(0, i) for i in range(copies)} | {(1, 100 + i) for i in range(copies)} | {(2, 200)} <= set(got) and not any(d == 3 for d, _ in got)
    assert got[0, 0] == pytest.approx(50 / 60) and got[1, 100] == pytest.approx(19 / 21)


def test_rows_do_not_depend_on_the_block_size(spark):
    rows, items = case()
    shared = sentence(random.Random(9), 30)
    items = [*items, *((300 + i, f"{shared} tail{i} end{i}") for i in range(6)), (400, shared), (401, shared.upper())]
    rows = [*rows, (900, f"{shared} tail1 end1"), (901, changed(shared, 2)), (902, f"{changed(shared, 1)} tail3 end3"), (903, f"{shared} tail2 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, *others = (sorted(map(tuple, leaks(docs, bench, block=b).collect())) for b in (20_000, 25, 7, 2))
    assert {900, 901, 902, 903} <= {r[0] for r in whole} and all(x == whole for x in others)


@pytest.mark.parametrize("shingles,other", [(27, 3), (45, 5)])
def test_pairs_at_the_threshold_are_within_the_radius(shingles, other):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, (4000, shingles)).astype(np.uint64)
    b = a.copy()
    b[:, :other] = rng.integers(0, 1 << 63, (4000, other)).astype(np.uint64)
    far = np.bitwise_count(fingerprints(a, np.ones(a.shape), shingles) ^ fingerprints(b, np.ones(b.shape), shingles)).sum(1)
    assert (far <= RADIUS).all()


def test_blocks_are_bounded_by_bytes_and_hold_a_text_once(spark):
    rng = random.Random(4)
    same = sentence(rng, 30)
    items = [(i, same) for i in range(500)] + [(1000 + i, sentence(rng, 40)) for i in range(60)]
    blocks = [some for some, _ in item_blocks(spark.createDataFrame(items, "item_id long, text string"), block_bytes=6000)]
    assert len(blocks) > 2
    assert sorted(((i, t) for some in blocks for ids, t in some for i in ids)) == sorted(items)
    assert sum(len(some) for some in blocks) == 61
    assert max(sum(len(t) for _, t in some) for some in blocks) < 12_000
