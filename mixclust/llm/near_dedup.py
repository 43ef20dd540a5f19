"""MinHash near-dedup with SetSketch registers.

1. Every text gets its set of word shingles, a hash of the set and SetSketch registers. Documents with
   equal sets are one from here on (the smallest id stands for them), so copies cost nothing more.
2. Band values of the registers put the sets into buckets. Sets in a bucket with others are made again in full, and
   those stay that share enough of their elements with others to have any link (set_links.linkable).
3. In each bucket every set is paired with the bucket's smallest id only. Pairs whose jointly estimated similarity
   (likelihood of the registers, sizes known) comes near the threshold are verified on their full sets.
4. Components of these links. Buckets that still hold sets of several components are searched for links across
   them on the full sets (set_links.cross_links), and the components are taken again. So no link is lost, a
   group of near copies costs about one pair for each member, and one of texts that are alike below the
   threshold gives no pairs at all.

A pair at the threshold shares no bucket with a probability below 1e-8 (0.85) or 4e-6 (0.8). Step 3 leaves out a pair
whose estimate falls below the margin (0.16 at 0.85, 0.17 at 0.8; one in a million at the threshold); step 4 then
finds it, as it asks no estimate.

Defined cases: null text is empty; an empty set (no words) is linked with nothing; a text of fewer words
than a shingle is one shingle. Rows that share an id are one document for the links, each with its own
set. A row with a null id gets no component and is kept. An empty table gives an empty result. Only
doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.components import components
from mixclust.llm.set_links import cross_links, linkable, verified_links
from mixclust.llm.setsketch import BANDS, REGISTERS, ROWS, WORDS, margin, shingle_sets, similarity, sketches
from mixclust.llm.words import Words, mix, row_blocks
from mixclust.session import written

THRESHOLD = 0.85
PAIRS_AT_ONCE = 100_000

_SKETCH = "doc_id long, n long, h long, h2 long, sketch binary"
_SET = "doc_id long, h long, n long, shingles binary"


def _set_hashes(value: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: sums of its mixed elements."""
    out = []
    for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value + np.uint64(k)), dtype=np.uint64)])
        out.append(mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in row_blocks(batch, "text"):
            value, offs = shingle_sets(Words(rows["text"], lower=True), WORDS)
            h, h2 = _set_hashes(value, offs)
            s = sketches(value, offs)
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(np.diff(offs), pa.int64()), pa.array(h), pa.array(h2), pa.array([x.tobytes() for x in s], pa.binary())], names=["doc_id", "n", "h", "h2", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in row_blocks(batch, "text"):
            value, offs = shingle_sets(Words(rows["text"], lower=True), WORDS)
            h, _ = _set_hashes(value, offs)
            keep = np.flatnonzero(h == rows["h"].to_numpy())
            packed = [value[offs[i] : offs[i + 1]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([rows["doc_id"].take(pa.array(keep)), pa.array(h[keep]), pa.array(np.diff(offs)[keep], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "h", "n", "shingles"])


def _registers(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _alike(least: float):
    """Pairs (with both sketches) whose estimate reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for at in range(0, b.num_rows, PAIRS_AT_ONCE):
                x = b.slice(at, PAIRS_AT_ONCE)
                n = [x[c].to_numpy().astype(float) for c in ("na", "nb")]
                keep[at : at + x.num_rows] = similarity(_registers(x["sa"]), _registers(x["sb"]), *n) >= least
            yield pa.RecordBatch.from_arrays([b[c].filter(pa.array(keep)) for c in ("a", "ha", "b", "hb")], names=["a", "ha", "b", "hb"])

    return run


def near_components(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links of at least ``threshold`` lead to) and
    kept (whether that is its own) of every row."""
    percent, least = round(threshold * 100), threshold - margin(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = written(docs.mapInArrow(_sketch, _SKETCH), "sketches")
    known = sketched.where("n > 0 and doc_id is not null")
    nodes = known.groupBy("h", "h2").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("sketch", i * ROWS + 1, F.lit(ROWS))).alias("key")))
    rows = nodes.select("doc", "h", F.explode(bands).alias("x")).select("doc", "h", F.col("x.key").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    members = written(rows.join(shared, "key"), "buckets")

    involved = members.select("doc", "h").distinct()
    sets = docs.join(involved.withColumnRenamed("doc", "doc_id"), "doc_id").mapInArrow(_sets, _SET)
    sets = written(sets.dropDuplicates(["doc_id", "h"]), "sets").select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "shingles")
    sets = linkable(sets, percent)
    members = members.join(sets.select(F.col("d").alias("doc"), F.col("k").alias("h"), "n", "most"), ["doc", "h"])
    members = written(members, "members")

    near = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    sketch = nodes.select(F.col("doc").alias("d"), F.col("h").alias("k"), F.col("sketch"))
    first = members.groupBy("key").agg(F.min(F.struct("doc", "h", "n")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    star = members.join(first, "key").where("first.h <> h").select(F.col("first.doc").alias("a"), F.col("first.h").alias("ha"), F.col("first.n").alias("na"), F.col("doc").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
    star = star.where(near).distinct()
    star = star.join(sketch.withColumnsRenamed({"d": "a", "k": "ha", "sketch": "sa"}), ["a", "ha"]).join(sketch.withColumnsRenamed({"d": "b", "k": "hb", "sketch": "sb"}), ["b", "hb"])
    links = verified_links(written(star.select("a", "ha", "na", "sa", "b", "hb", "nb", "sb").mapInArrow(_alike(least), "a long, ha long, b long, hb long"), "pairs"), sets, percent)
    labels = components(links)

    labelled = members.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    more = cross_links(labelled, sets, percent)
    labels = components(links.union(more)) if not more.isEmpty() else labels

    # sets first, which have one row each: documents meet the result by their set, where Spark can split copies
    stands = nodes.select("h", "h2", "doc").join(labels.withColumnRenamed("id", "doc"), "doc", "left")
    out = sketched.join(stands, ["h", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
