"""Links between sets of 64-bit elements: counts of elements over all sets, exact checks of pairs, and the search for
links across components.

Sets come as tables (d, k, shingles): an id and a hash that name the set, and its sorted elements, packed.

Element counts: sets are dealt to blocks, each block sends one entry for each of its distinct elements to the bucket
of the element, and gets the sum over all blocks back. An element that a third of all sets holds costs its
bucket one entry for each block.

Links across components: a pair is looked for only in buckets that hold sets of several components, and only if the
elements that a set shares with any other could make a link with a set as small as the bucket's least. What is
left is compared in tiles of bounded size, in the task that holds their sets: a lower bound of the symmetric
difference from bitmaps first, then the sets themselves. Only links that join two components go out, so a
tile gives fewer rows than it has sets, whatever the number of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.words import mix
from mixclust.session import written

TILE = 1024
TILE_ELEMENTS = 1 << 21
PAIRS_AT_ONCE = 1 << 17
BLOCK_BYTES = 256 << 20
MANY = 255
_PACKET = "block int, bucket int, elements binary"
_ANSWER = "block int, bucket int, counts binary"


def unpack(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of packed sets, end to end, and the n + 1 offsets of the sets."""
    parts = col.to_pylist()
    offs = np.concatenate([[0], np.cumsum([len(p) // 8 for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint64), offs


def _bucket(elements: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the element, so a sorted array meets its buckets in order."""
    return ((elements >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _send(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        kinds, n = np.unique(unpack(t["shingles"])[0], return_counts=True)
        n = np.minimum(n, MANY).astype(np.uint8)
        to = _bucket(kinds, buckets)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
        out: list[tuple] = []
        block = t["block"][0].as_py()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                out.append((block, int(to[a]), kinds[a:b].tobytes() + n[a:b].tobytes()))
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate((("block", pa.int32()), ("bucket", pa.int32()), ("elements", pa.binary())))})

    return run


def _sum_up(t: pa.Table) -> pa.Table:
    packets = t["elements"].to_pylist()
    size = [len(x) // 9 for x in packets]
    _, at = np.unique(np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(packets, size, strict=True)]), return_inverse=True)
    total = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    np.add.at(total, at, np.concatenate([np.frombuffer(x, np.uint8, n, 8 * n) for x, n in zip(packets, size, strict=True)]))
    total = np.minimum(total, MANY).astype(np.uint8)
    back = [x.tobytes() for x in np.split(total[at], np.cumsum(size)[:-1])]
    return pa.table({"block": t["block"].combine_chunks(), "bucket": t["bucket"].combine_chunks(), "counts": pa.array(back, pa.binary())})


def with_counts(sets: DataFrame, use: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``use`` of each block of ``sets`` (columns d, k, shingles and others), their elements, the offsets of the sets and
    the number of sets of the whole table that hold each element (MANY stands for more, too)."""
    conf = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    blocks = max(conf, -(-size // BLOCK_BYTES))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("d", "k"), F.lit(blocks)).cast("int"))
    packets = dealt.groupBy("block").applyInArrow(_send(blocks), _PACKET)
    answers = packets.groupBy("bucket").applyInArrow(_sum_up, _ANSWER)

    def gather(own: pa.Table, got: pa.Table) -> pa.Table:
        elements, offs = unpack(own["shingles"])
        _, at = np.unique(elements, return_inverse=True)
        order = np.argsort(got["bucket"].to_numpy(), kind="stable")
        parts = got["counts"].to_pylist()
        total = np.frombuffer(b"".join([parts[i] for i in order]), np.uint8)
        return use(own.drop_columns(["block"]), elements, offs, total[at].astype(np.int64) if len(at) else np.empty(0, np.int64))

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(gather, schema)


def _verified(percent: int):
    """Pairs (with both full sets) of at least ``percent`` hundredths of Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["xa"], b["xb"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, ha, b, hb) whose sets are alike, checked on the full sets; a written table."""
    one = pairs.join(sets.select(F.col("d").alias("a"), F.col("k").alias("ha"), F.col("shingles").alias("xa")), ["a", "ha"])
    two = one.join(sets.select(F.col("d").alias("b"), F.col("k").alias("hb"), F.col("shingles").alias("xb")), ["b", "hb"])
    return written(two.select("a", "b", "xa", "xb").mapInArrow(_verified(percent), "a long, b long"), "verified")


def partners(percent: int, n: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of n elements, ``shared`` of which are in other sets too, can have a link at all, and the largest size of a
    partner: |a & b| is at most ``shared``, and reaches percent / (100 + percent) of |a| + |b|."""
    return (n > 0) & (100 * shared >= percent * n), shared * (100 + percent) // percent - n


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """The ``sets`` that share enough elements with others to have a link, with their size n and the largest size of a
    partner, most; a written table."""

    def use(own: pa.Table, elements: np.ndarray, offs: np.ndarray, count: np.ndarray) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(count > 1)])
        n = np.diff(offs)
        ok, most = partners(percent, n, total[offs[1:]] - total[offs[:-1]])
        out = pa.table({"d": own["d"], "k": own["k"], "n": pa.array(n, pa.int64()), "most": pa.array(most, pa.int64()), "shingles": own["shingles"]})
        return out.filter(pa.array(ok))

    return written(with_counts(sets.select("d", "k", "shingles"), use, "d long, k long, n long, most long, shingles binary"), "linkable")


def _bitmaps(elements: np.ndarray, offs: np.ndarray, bits: int) -> np.ndarray:
    """Of each set, for each of ``bits`` classes whether the number of its elements there is odd. Two sets differ in
    as many elements at least as their bitmaps do in bits."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    at = row * bits + (mix(elements) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.uint64)


def links_in_tile(part: np.ndarray, same_part: bool, doc: np.ndarray, component: np.ndarray, most: np.ndarray, elements: np.ndarray, offs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components of the sets of one tile: enough of them to join all that are linked. ``most``: the
    largest size of a partner."""
    n = np.diff(offs)
    _, comp = np.unique(component, return_inverse=True)
    parent = list(range(int(comp.max(initial=-1)) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out: list[tuple[int, int]] = []
    bits = 256
    while bits < 16 * int(n.max(initial=1)):
        bits *= 2
    order = np.argsort(n, kind="stable")  # partners of one set are next to each other by size
    maps, open_sets = None, len(parent)
    end = np.searchsorted(n[order], (100 * n[order]) // percent, "right")
    size = np.maximum(0, end - np.arange(len(n)) - 1)
    total, at = np.cumsum(size), 0
    while at < len(n) and open_sets > 1:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        i = np.repeat(np.arange(at, to), size[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
        at = to
        i, j = order[i], order[j]
        ok = (comp[i] != comp[j]) & (n[j] <= most[i]) & (n[i] <= most[j])
        if not same_part:
            ok &= part[i] != part[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if len(i) > 64:
            if maps is None:
                maps = _bitmaps(elements, offs, bits)
            step, keep = max(1, (1 << 22) // maps.shape[1]), []
            for a in range(0, len(i), step):
                x, y = i[a : a + step], j[a : a + step]
                differ = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)
                keep.append((100 + percent) * differ <= (100 - percent) * (n[x] + n[y]))
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(int(comp[a])), find(int(comp[b]))
            if p == q:
                continue
            x, y = elements[offs[a] : offs[a + 1]], elements[offs[b] : offs[b + 1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                parent[p] = q
                open_sets -= 1
                out.append((int(doc[a]), int(doc[b])))
    return out


_TILE = ("key", "ti", "tj", "part", "doc", "component", "most", "shingles")


def _tiles(percent: int):
    """Links of the tiles of rows that are sorted by tile."""

    def links(t: pa.Table) -> pa.RecordBatch:
        key, ti, tj, part, doc, component, most = (t[c].to_numpy() for c in _TILE[:-1])
        elements, offs = unpack(t["shingles"])
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])) + 1, [len(key)]])
        found: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                found += links_in_tile(part[a:b], bool(ti[a] == tj[a]), doc[a:b], component[a:b], most[a:b], elements[offs[a] : offs[b]], offs[a : b + 1] - offs[a], percent)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last tile may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            ends = [b[c][-1].as_py() for c in _TILE[:3]]
            tail = np.logical_and.reduce([b[c].to_numpy() == v for c, v in zip(_TILE[:3], ends, strict=True)])
            cut = 0 if tail.all() else b.num_rows - int(np.argmin(tail[::-1]))
            if held and (cut or [held[-1][c][-1].as_py() for c in _TILE[:3]] != ends):
                yield links(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield links(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold sets of several components, but for those too far in size from all others."""
    keys = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least")).where("x <> y").select("key", "least")
    return members.join(keys, "key").where("most >= least").drop("least")


def cross_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join components, of all pairs of sets that share a bucket. ``members``: key, doc, h (of the
    set), n (its size), most (the largest size of a partner) and component, one row for each bucket of a set;
    ``sets``: the sets of all of them."""
    left = written(_open(_open(members.select("key", "doc", "h", "n", "most", "component"))), "open")
    # buckets that hold the same sets are one
    alike = left.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("elements"), F.sum(F.xxhash64("doc", "h").cast("decimal(38,0)")).alias("s"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    alike = alike.groupBy("c", "s", "elements").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("c") / TILE), F.ceil(F.col("elements") / TILE_ELEMENTS)).cast("int")
    left = left.join(alike.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("h", "key"), F.col("parts")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(F.least(t, F.col("part")).alias("ti"), F.greatest(t, F.col("part")).alias("tj")))
    left = left.withColumn("tile", F.explode(tiles)).select("key", "tile.ti", "tile.tj", "part", "doc", "h", "component", "most")
    left = left.join(sets.select(F.col("d").alias("doc"), F.col("k").alias("h"), "shingles"), ["doc", "h"]).select(*_TILE)
    left = left.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")
    return written(left.mapInArrow(_tiles(percent), "a long, b long").distinct(), "cross-links")
