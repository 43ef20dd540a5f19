"""Exact Jaccard join of n-gram sets by prefixes of token combinations.

Tokens are word n-grams. A set with a partner at the threshold t lacks at most |s| - ceil(t |s|) of its own tokens there, so
in any order of the tokens the first k that the two have in common lie within the first |s| - ceil(t |s|) + k
tokens of each: its k-extended prefix.

1. By hash order: sets whose extended prefix (k of (1 - t) |s|) holds fewer tokens of other sets' prefixes than a partner
   would make it hold are out. Most texts have no near copy and end here, with a third of their tokens sent.
2. Of the others, the full sets and the number of sets that hold each of their tokens (set_links.with_counts). Sets that
   share too few tokens for any link are out; the rest order their tokens by that number, rarest first.
3. Index. Tokens of up to RARE sets are rare. Two sets of at most SHORT tokens (the smaller one) have a rare token in
   common in their 2-extended prefixes, or two frequent ones: each rare token is a key, and each pair of
   frequent tokens is one. Longer sets, whose prefixes would give too many pairs, have each token as a key.
4. In each bucket the sets are verified against the one with fewest tokens of its own; components of these links; buckets
   that hold several components are searched for links across them in full (set_links.cross_links).

So all links of different sets are taken into account, but a group of m near copies is verified about m times and not
m^2 / 2 times. Equal sets are one set from the start.

Defined cases: null text is empty; an empty set is linked with nothing; a text of fewer words than an n-gram is one token. Rows
that share an id are one document for the links, each with its own set. A row with a null id gets no component.
An empty table gives an empty result. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.components import components
from mixclust.llm.near_dedup import _set_hashes
from mixclust.llm.set_links import MANY, cross_links, partners, verified_links, with_counts
from mixclust.llm.setsketch import shingle_sets
from mixclust.llm.words import Words, join_ids, mix, row_blocks
from mixclust.session import written

WORDS = 4
PERCENT = 85
RARE = 8
SHORT = 128
BROADCAST = 32 << 20
ROW_BYTES = 64  # of a row of two ids in a broadcast, at most

_NODE = "doc_id long, n long, h long, h2 long, shingles binary"
_SET = "d long, k long, shingles binary"
_INDEX = "d long, k long, n long, own long, keys binary, shingles binary"
_ROWS = "key long, most long, doc long, h long, n long, own long"


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(t n): the tokens that a set of n has in common with a partner, at least."""
    return -(-(n * percent) // 100)


def extension(n: np.ndarray, percent: int) -> np.ndarray:
    """By how many tokens the prefix of a set of n is extended in step 1."""
    return -(-(n * (100 - percent)) // 100)


def _prefixes(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_blocks(batch, "text"):
                value, offs = shingle_sets(Words(rows["text"], lower=True), words)
                h, h2 = _set_hashes(value, offs)
                n = np.diff(offs)
                size = np.minimum(n, n - needed(n, percent) + extension(n, percent))
                packed = [value[a : a + s].tobytes() for a, s in zip(offs[:-1], size, strict=True)]
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(n, pa.int64()), pa.array(h), pa.array(h2), pa.array(packed, pa.binary())], names=["doc_id", "n", "h", "h2", "shingles"])

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_blocks(batch, "text"):
                value, offs = shingle_sets(Words(rows["text"], lower=True), words)
                h, _ = _set_hashes(value, offs)
                keep = np.flatnonzero(h == rows["k"].to_numpy())
                packed = [value[offs[i] : offs[i + 1]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([rows["doc_id"].take(pa.array(keep)), pa.array(h[keep]), pa.array(packed, pa.binary())], names=["d", "k", "shingles"])

    return run


def _promising(percent: int):
    """Of sets with their prefixes: those that hold as many tokens of others as a partner of the least size would need."""

    def use(own: pa.Table, elements: np.ndarray, offs: np.ndarray, count: np.ndarray) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(count > 1)])
        least = extension(needed(own["n"].to_numpy(), percent), percent)
        return own.select(["d", "k"]).filter(pa.array(total[offs[1:]] - total[offs[:-1]] >= least))

    return use


def keys_of(tokens: np.ndarray, count: np.ndarray, percent: int, rare: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set, and for each the most tokens that the set can have in common with another if the key is among
    the first that they have in common. ``count``: the number of sets that hold each token."""
    order = np.lexsort((tokens, count))
    tokens, count = tokens[order], count[order]
    n = len(tokens)
    least = int(needed(np.int64(n), percent))
    keys, common = [], []
    combined = percent * n <= 100 * short and 2 * (100 - percent) <= percent  # the smaller of a pair can be short, and has two in common
    if combined:
        own, some, end = (int(np.searchsorted(count, c, "right")) for c in (1, rare, n + MANY))
        end = min(end, n - least + 2)
        few = np.arange(own, max(own, min(some, end)))
        keys.append(mix(tokens[few] ^ np.uint64(0x5851F42D4C957F2D)))
        common.append(n - few + 1)  # one more can come before
        many = np.arange(min(some, end), end)
        i, j = np.triu_indices(len(many), 1)
        keys.append(join_ids(tokens[many[i]], tokens[many[j]]))
        common.append(n - many[j] + 1)
    if n > short or not combined:
        at = np.arange(int(np.searchsorted(count, 1, "right")), n - least + 1)
        keys.append(mix(tokens[at] ^ np.uint64(0x14057B7EF767814F)))
        common.append(n - at)
    return np.concatenate(keys), np.concatenate(common)


def _indexed(percent: int, rare: int, short: int):
    def use(own: pa.Table, elements: np.ndarray, offs: np.ndarray, count: np.ndarray) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(count > 1)])
        n = np.diff(offs)
        shared = total[offs[1:]] - total[offs[:-1]]
        ok, most = partners(percent, n, shared)
        keys = []
        for a, b, good, best in zip(offs[:-1], offs[1:], ok, most, strict=True):
            if good:
                key, common = keys_of(elements[a:b], count[a:b], percent, rare, short)
                reach = np.minimum(common * (100 + percent) // percent - (b - a), best)
                keys.append(key.tobytes() + reach.astype(np.uint64).tobytes())
            else:
                keys.append(None)
        out = pa.table({"d": own["d"], "k": own["k"], "n": pa.array(n, pa.int64()), "own": pa.array(1000 * (n - shared) // np.maximum(n, 1), pa.int64()), "keys": pa.array(keys, pa.binary()), "shingles": own["shingles"]})
        return out.filter(pa.array(ok))

    return use


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a set; most: the largest partner that can have that key among the first in common."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            some = b.slice(at, 512)
            parts = some["keys"].to_pylist()
            size = [len(p) // 16 for p in parts]
            take = pa.array(np.repeat(np.arange(len(parts)), size))
            both = [np.concatenate([np.empty(0, np.int64), *(np.frombuffer(p, np.int64, k, f * 8 * k) for p, k in zip(parts, size, strict=True))]) for f in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), *(some[c].take(take) for c in ("d", "k", "n", "own"))], names=["key", "most", "doc", "h", "n", "own"])


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, rare: int = RARE, short: int = SHORT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links of at least ``percent`` hundredths lead to) of
    every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(docs.mapInArrow(_prefixes(words, percent), _NODE), "prefixes")
    known = first.where("n > 0 and doc_id is not null")
    nodes = written(known.groupBy("h", "h2").agg(F.min("doc_id").alias("d"), F.max("n").alias("n"), F.max("shingles").alias("shingles")), "nodes")
    named = nodes.select("d", F.col("h").alias("k"), "n", "shingles")
    promising = written(with_counts(named, _promising(percent), "d long, k long"), "promising")

    promising = promising.withColumnRenamed("d", "doc_id")
    if promising.count() * ROW_BYTES <= BROADCAST:
        promising = F.broadcast(promising)  # else both are shuffled
    sets = docs.join(promising, "doc_id").mapInArrow(_full_sets(words), _SET)
    sets = written(sets.dropDuplicates(["d", "k"]), "sets")
    sets = written(with_counts(sets, _indexed(percent, rare, short), _INDEX), "indexed")
    index = written(sets.select("d", "k", "n", "own", "keys").mapInArrow(_rows, _ROWS), "index")

    head = index.groupBy("key").agg(F.min(F.struct("own", "doc", "h", "n", "most")).alias("first"), F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).where("size > 1").drop("size")
    members = written(index.join(head, "key").where("most >= least").drop("least"), "buckets")
    star = members.where("first.h <> h and n <= first.most and first.n <= most").select(F.col("first.doc").alias("a"), F.col("first.h").alias("ha"), F.col("doc").alias("b"), F.col("h").alias("hb")).distinct()
    links = verified_links(star, sets, percent)
    labels = components(links)
    labelled = members.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    more = cross_links(labelled, sets, percent)
    labels = components(links.union(more)) if not more.isEmpty() else labels

    stands = nodes.select("h", "h2", F.col("d").alias("doc")).join(labels.withColumnRenamed("id", "doc"), "doc", "left")
    out = first.select("doc_id", "n", "h", "h2").join(stands, ["h", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
