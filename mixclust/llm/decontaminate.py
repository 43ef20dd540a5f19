"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted check.

For each size of a benchmark item the documents' windows of as many words get a 128-bit SimHash of their
weighted word shingles (weight: 1 over the number of distinct item texts that hold the shingle; a window's
shingles without a weight get the mean of its others). Fingerprints
are cut into BLOCKS blocks; two that differ in at most RADIUS bits differ in at most RADIUS // BLOCKS bits
of some block, so the index, probed with all values that near in each block, finds every item within the
radius. Candidates are then held to the exact weighted Jaccard similarity, where each shingle of the window that
the item lacks weighs as much as the item's own do on average, so changes count alike in common and rare items.

Windows with equal weights just over the threshold differ in 19 bits on average (sd 4). Of 40,000 simulated
pairs each of 27, 45, 46 and 50 shingles with 3, 5, 5 and 5 changed, 0.4 to 1.2% lay beyond radius 28, at most
one beyond 39.

A window is fingerprinted only if the shingles that it shares with items of its size could reach the
threshold by weight, a bound that loses nothing that the exact check would accept.

The benchmark's distinct texts go to the tasks in blocks of about ``block`` texts and BLOCK_BYTES bytes at most, one pass over the documents each, with
the weights of the whole benchmark; documents are never shuffled.

Defined cases: null texts and items count as empty; an item without words is never found; an item of fewer
words than a shingle is one shingle; of items with the same id each text counts alone, an item
without an id is returned with a null one; rows are judged alone, so
copies and null ids need no care (a null doc_id is carried); empty tables give empty results (or all
documents as clean).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.setsketch import WORDS
from mixclust.llm.words import Words, mix, row_blocks, windows
from mixclust.session import written

THRESHOLD = 0.8
BITS, BLOCKS, RADIUS = 128, 8, 39
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
WINDOWS_AT_ONCE = 4096
_WIDTH = BITS // BLOCKS
_LOW = np.uint64((1 << _WIDTH) - 1)


def _bits(ids: np.ndarray) -> np.ndarray:
    """The BITS signs (+1, -1) of each shingle id."""
    both = np.stack([mix(ids + np.uint64(k + 1)) for k in range(BITS // 64)], 1)
    return np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def fingerprints(ids: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHash blocks (n, BLOCKS) of n windows from their shingle ids (n, size) and weights."""
    signs = _bits(ids.ravel()).reshape(len(ids), size, BITS)
    total = np.einsum("nsb,ns->nb", signs, weights.astype(np.float32))
    return np.packbits(total > 0, axis=1, bitorder="little").view("<u2").astype(np.int64)


def _distinct(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights with those of repeated ids in a window set to 0."""
    order = np.argsort(ids, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    out = weights.copy()
    np.put_along_axis(out, order, np.where(again, 0, np.take_along_axis(weights, order, 1)), 1)
    return out


@dataclass
class Size:
    """The items of one size (in words)."""

    words: int
    items: list  # of each text: what came with it, the ids of its items
    ids: np.ndarray  # (items, shingles)
    weights: np.ndarray  # of them; a repeated shingle counts once
    prints: np.ndarray  # (items, BLOCKS)
    least: float  # the least weight that a window must share with an item
    held: np.ndarray  # whether some item holds each of the index's shingles
    values: list[np.ndarray]  # of each block: the values that items have, sorted, ...
    starts: list[np.ndarray]  # ... where the items of each value begin in ...
    order: list[np.ndarray]  # ... this order of the items


@dataclass
class Index:
    """Items by size, and all their shingles."""

    sizes: list[Size]
    keys: np.ndarray  # the distinct shingle ids, sorted
    weights: np.ndarray  # of them
    seen: np.ndarray  # whether some shingle id has these leading bits


_LEADING = np.uint64(64 - 18)


def build_index(items: list[tuple], threshold: float, counts: tuple[np.ndarray, np.ndarray] | None = None) -> Index:
    """The index of some texts (ids, text); ``counts``: shingles that several texts of the benchmark hold, sorted,
    and how many do (none: ``items`` are the benchmark)."""
    words = Words(pa.array([t for _, t in items], pa.string()), lower=True)
    ids = words.hashes()
    by_size: dict[int, list[int]] = {}
    shingles: list[np.ndarray] = []
    for i in range(len(items)):
        own = ids[words.first[i] : words.first[i + 1]]
        shingles.append(windows(own, min(WORDS, max(1, len(own)))))
        if len(own):
            by_size.setdefault(len(own), []).append(i)
    texts = {s.tobytes(): np.unique(s) for s in shingles}
    keys, count = np.unique(np.concatenate([np.empty(0, np.uint64), *texts.values()]), return_counts=True)
    if counts is not None:
        count = np.ones(len(keys), np.int64)
        count[np.searchsorted(keys, counts[0])] = counts[1]
    sizes = []
    for n, at in sorted(by_size.items()):
        s = np.stack([shingles[i] for i in at])
        place = np.searchsorted(keys, s)
        once = _distinct(s, 1.0 / count[place])
        prints = fingerprints(s, once, s.shape[1])
        held = np.zeros(len(keys), bool)
        held[place] = True
        order = [np.argsort(prints[:, b], kind="stable") for b in range(BLOCKS)]
        values = [np.unique(prints[:, b]) for b in range(BLOCKS)]
        starts = [np.append(np.searchsorted(prints[o, b], v), len(o)) for b, (o, v) in enumerate(zip(order, values, strict=True))]
        sizes.append(Size(n, [items[i][0] for i in at], s, once, prints, threshold * float(once.sum(1).min()), held, values, starts, order))
    seen = np.zeros(1 << (64 - int(_LEADING)), bool)
    seen[keys >> _LEADING] = True
    return Index(sizes, keys, 1.0 / count, seen)


def hits(g: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``g`` of shingles that the index has, and their numbers there."""
    if not len(index.keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.flatnonzero(index.seen[g >> _LEADING])
    key = np.minimum(np.searchsorted(index.keys, g[place]), len(index.keys) - 1)
    ok = index.keys[key] == g[place]
    return place[ok], key[ok]


def near_values() -> np.ndarray:
    """Masks of at most RADIUS // BLOCKS bits of a block."""
    return np.array([sum(1 << b for b in some) for k in range(RADIUS // BLOCKS + 1) for some in combinations(range(_WIDTH), k)], np.int64)


def within_radius(size: Size, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) numbers of all pairs that differ in at most RADIUS bits, by probing each block."""
    masks, n_items = near_values(), len(size.items)
    found = []
    for b in range(BLOCKS):
        # (window, value) numbers: the values of items that near to the window's own
        values = size.values[b]
        if len(values) < len(masks):
            w, v = np.nonzero(np.bitwise_count(prints[:, b][:, None] ^ values[None]) <= RADIUS // BLOCKS)
        else:
            probe = prints[:, b][:, None] ^ masks[None]
            v = np.minimum(np.searchsorted(values, probe), len(values) - 1)
            w, m = np.nonzero(values[v] == probe)
            v = v[w, m]
        first, n = size.starts[b][v], size.starts[b][v + 1] - size.starts[b][v]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found.append(np.repeat(w, n) * n_items + size.order[b][at])
    pairs = np.unique(np.concatenate(found))
    w, i = pairs // n_items, pairs % n_items
    ok = np.bitwise_count(prints[w] ^ size.prints[i]).sum(1) <= RADIUS
    return w[ok], i[ok]


def find(rows: pa.RecordBatch, index: Index, threshold: float) -> Iterator[tuple[int, tuple, int, int, float]]:
    """(row, ids, first word, words, similarity) of the best window of each row and text that reaches
    ``threshold``."""
    words = Words(rows["text"], lower=True)
    ids = words.hashes()
    grams = {n: windows(ids, n) for n in {min(WORDS, s.words) for s in index.sizes}}
    known = {n: hits(g, index) for n, g in grams.items()}
    best: dict[tuple[int, int, int], tuple[float, int]] = {}  # of (row, words of the text, its number among these)
    items = {size.words: size.items for size in index.sizes}
    for size in index.sizes:
        k = size.ids.shape[1]
        g, (place, key) = grams[min(WORDS, size.words)], known[min(WORDS, size.words)]
        own = size.held[key]
        hit, weight = place[own], index.weights[key[own]]
        if not len(hit):
            continue
        start = np.unique(hit[:, None] - np.arange(k)[None])
        start = start[(start >= 0) & (start + size.words <= len(words))]
        start = start[start + size.words <= words.first[words.row[start] + 1]]
        total = np.concatenate([[0.0], np.cumsum(weight)])
        start = start[total[np.searchsorted(hit, start + k)] - total[np.searchsorted(hit, start)] >= size.least - 1e-6]
        for lot in range(0, len(start), WINDOWS_AT_ONCE):
            s = start[lot : lot + WINDOWS_AT_ONCE]
            at = s[:, None] + np.arange(k)[None]
            mine = g[at]
            found = np.minimum(np.searchsorted(place, at), len(place) - 1)
            known_here, weight_of = place[found] == at, index.weights[key[found]]
            mean = (weight_of * known_here).sum(1) / known_here.sum(1)
            once = _distinct(mine, np.ones(mine.shape))
            w, i = within_radius(size, fingerprints(mine, once * np.where(known_here, weight_of, mean[:, None]), k))
            for a, b in zip(w.tolist(), i.tolist(), strict=True):
                common, whole = float(size.weights[b][np.isin(size.ids[b], mine[a])].sum()), float(size.weights[b].sum())
                others = float(once[a][~np.isin(mine[a], size.ids[b])].sum())
                alike = common / (whole + others * whole / np.count_nonzero(size.weights[b]))
                if alike >= threshold - 1e-9:
                    row, first = int(words.row[s[a]]), int(s[a] - words.first[words.row[s[a]]])
                    name, value = (row, size.words, b), (alike, -first)
                    best[name] = max(best.get(name, value), value)
    for (row, n, b), (alike, first) in sorted(best.items()):
        yield row, items[n][b], -first, n, round(alike, 9)


def item_shingles(items: DataFrame) -> DataFrame:
    """(words, h): the distinct shingles of each item, and a hash of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_blocks(batch, "text"):
                words = Words(rows["text"], lower=True)
                ids = words.hashes()
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    if a < b:
                        h = np.unique(windows(ids[a:b], min(WORDS, int(b - a))))
                        whole = np.repeat(windows(ids[a:b], int(b - a)), len(h))
                        yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(h.view(np.int64))], names=["words", "h"])

    return items.select("text").mapInArrow(run, "words long, h long")


def indexes(items: DataFrame, threshold: float, block: int) -> Iterator[Index]:
    """The index of each block of items, with shingle counts over the distinct texts of the whole benchmark."""
    counts = item_shingles(items).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written(counts, "item-shingles")
    for some, part in item_blocks(items, block):
        own = counts.join(item_shingles(part).select("h").distinct(), "h", "left_semi").toArrow()
        h, n = own["h"].to_numpy().view(np.uint64), own["n"].to_numpy()
        order = np.argsort(h)
        yield build_index(some, threshold, (h[order], n[order]))


def item_blocks(items: DataFrame, block: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[tuple, str]], DataFrame]]:
    """The distinct texts of the benchmark, each with the ids of its items, in lists of about ``block`` texts and ``block_bytes``
    bytes at most, by a hash of the text, and as tables. A null id is an id as others (None)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = items.groupBy("text").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("nameless"))
    texts = written(texts, "item-texts")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 8 * F.size("ids")).alias("bytes")).first()
    # a quarter more blocks than needed: hashes fill unevenly
    n = max(1, -(-size["n"] * 5 // (4 * block)), -(-(size["bytes"] or 0) * 5 // (4 * block_bytes)))
    for k in range(n):
        part = texts if n == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        rows = sorted(part.collect(), key=lambda r: r["text"])
        yield [((*sorted(r["ids"]), *([None] if r["nameless"] else [])), r["text"]) for r in rows], part


_FOUND = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, n_words and similarity of the best window of each document and item of at
    least ``threshold``."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts: list[DataFrame] = []
    index = None
    for own in indexes(items, threshold, block):
        if index is not None:  # one index at a time, on the driver and the executors
            parts[-1] = written(parts[-1], "leaks")
            index.destroy()
        index = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in row_blocks(batch, "text"):
                    if found := [(row, item, *rest) for row, ids, *rest in find(rows, index.value, threshold) for item in ids]:
                        row, *cols = zip(*found, strict=True)
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([rows["doc_id"].take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        parts.append(source.mapInArrow(run, _FOUND))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` (all columns) without a window that reaches ``threshold`` with an item."""
    spark = docs.sparkSession
    for own in indexes(items, threshold, block):
        index = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in row_blocks(batch, "text"):
                    keep = np.ones(rows.num_rows, bool)
                    keep[sorted({f[0] for f in find(rows, index.value, threshold)})] = False
                    yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
