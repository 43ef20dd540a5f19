"""Substring dedup by level-wise doubling.

A word is removed if a window of ``min_words`` consecutive words that covers it also starts in a
document with a smaller id. Window lengths double up to ``min_words`` (25, then 50). A window of
one length is compared only while the window of half that length that stands for it was found in
two documents; the loop ends at full length, or earlier when no candidate survives.

* At a lower level one window stands for each full-length window: the one with the least hash
  inside it (the same in every copy), about one position in fourteen. At the last level every
  position that is still a candidate is compared, so the result is exact (64-bit hashes).
* Occurrences travel as packed arrays, not as rows: a packet per task and hash bucket. Inside a
  task only the smallest document of each hash is sent on; the others are answered there. So a
  passage held by a third of all documents costs its bucket at most one entry per task.
* The candidates of each level are a table in the shared folder.

Defined cases: null text has no words; a null ``doc_id`` takes no part (nothing is removed from
that row, and it removes nothing); rows that repeat a ``doc_id`` don't remove words from each other;
texts shorter than ``min_words`` stay whole; an empty table gives an empty result; any further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.words import Words, inside, mix, row_blocks, sliding, windows
from mixclust.session import written

MIN_WORDS = 50
FIRST_LEVEL = 25
ENTRIES = 1 << 21  # occurrences that a task holds before it sends them on

_PACKET = "bucket int, done boolean, h binary, docs binary, tags binary, counts binary, pos binary"
_ANSWER = "bucket int, docs binary, tags binary, counts binary, pos binary"
_MARKS = "doc_id long, marks array<struct<tag:int,pos:binary>>"
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def levels(min_words: int = MIN_WORDS, first: int = FIRST_LEVEL) -> list[int]:
    """Window lengths, each at most twice the one before, up to ``min_words``."""
    out = [min_words]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def row_tags(words: Words, ids: np.ndarray) -> np.ndarray:
    """A number of each row's words, to tell rows of the same id apart."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(ids, dtype=np.uint64)])
    return (mix(total[words.first[1:]] - total[words.first[:-1]]) >> np.uint64(33)).astype(np.int32)


def marked(words: Words, tags: np.ndarray, marks: list | None) -> np.ndarray:
    """Whether each position was found repeated; ``marks``: per row, (tag, positions) pairs."""
    out = np.zeros(len(words), bool)
    for i, found in enumerate(marks or []):
        for m in found or ():
            if m["tag"] == tags[i]:
                out[words.first[i] + np.frombuffer(m["pos"], np.uint32).astype(np.int64)] = True
    return out


def _level(batches: Iterator[pa.RecordBatch], below: int, n: int, least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packets of the windows of ``n`` words that stand for windows of ``least`` words which are
    still candidates after the level ``below`` (0: all are)."""
    held, size = [], 0
    part = TaskContext.get().partitionId() % buckets
    for batch in batches:
        for rows in row_blocks(batch, "text"):
            words = Words(rows["text"])
            ids = words.hashes()
            alive = inside(words, least)
            if not alive.any():
                continue
            tags = row_tags(words, ids)
            doc = rows["doc_id"].fill_null(-1).to_numpy(zero_copy_only=False)
            known = rows["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            alive &= known[words.row[: len(alive)]]
            if below:
                got = marked(words, tags, rows["marks"].to_pylist())
                g = windows(ids, below)
                span = least - below + 1
                alive &= sliding(np.where(got[: len(g)], g, _TOP), span, True) == sliding(g, span, True)
                alive &= sliding(got[: len(g)].view(np.uint8), span, False) > 0
            g = windows(ids, n)
            span = least - n + 1
            best = np.where(alive, sliding(g, span, True), np.uint64(0))
            pad = np.zeros(span - 1, np.uint64)
            at = np.flatnonzero((sliding(np.concatenate([pad, best, pad]), span, False) == g) & (g != 0))
            row = words.row[at]
            held.append((g[at], doc[row], tags[row], (at - words.first[row]).astype(np.uint32)))
            size += len(at)
            if size >= ENTRIES:
                yield _packets(held, n == least, buckets, part)
                held, size = [], 0
    if size:
        yield _packets(held, n == least, buckets, part)


def _packets(held: list, last: bool, buckets: int, part: int) -> pa.RecordBatch:
    h, doc, tag, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((pos, doc, h))
    h, doc, tag, pos = h[order], doc[order], tag[order], pos[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(begin, len(h)))
    first = np.repeat(doc[begin], count)
    later = doc > first
    answered = later if last else later | (np.repeat(doc[begin + count - 1], count) > first)
    out = {k: [] for k in ("bucket", "done", "h", "docs", "tags", "counts", "pos")}

    def add(bucket: int, done: bool, pick: np.ndarray) -> None:
        pick = pick[np.lexsort((pos[pick], tag[pick], doc[pick]))]
        d, t = doc[pick], tag[pick]
        runs = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
        values = (bucket, done, b"" if done else h[pick].tobytes(), d[runs].tobytes(), t[runs].tobytes(), np.diff(np.append(runs, len(d))).astype(np.int32).tobytes(), pos[pick].tobytes())
        for k, v in zip(out, values, strict=True):
            out[k].append(v)

    if answered.any():
        add(part, True, np.flatnonzero(answered))
    sent = np.flatnonzero(~later)
    to = (h[sent] >> np.uint64(16)) % np.uint64(buckets)
    sent = sent[np.argsort(to, kind="stable")]
    for part_of in np.split(sent, np.flatnonzero(np.diff(np.sort(to))) + 1):
        if len(part_of):
            add(int((h[part_of[0]] >> np.uint64(16)) % np.uint64(buckets)), False, part_of)
    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _answers(table: pa.Table, last: bool, buckets: int) -> pa.Table:
    """Positions of one bucket whose window is in another document (at the last level: in one with a
    smaller id), packed for the buckets of their documents."""

    def whole(rows: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows[name].to_pylist()), kind)

    parts = []
    for done in (True, False):
        rows = table.filter(pc.equal(table["done"], done))
        counts = whole(rows, "counts", np.int32)
        doc, tag, pos = np.repeat(whole(rows, "docs", np.int64), counts), np.repeat(whole(rows, "tags", np.int32), counts), whole(rows, "pos", np.uint32)
        if not done and len(pos):
            h = whole(rows, "h", np.uint64)
            order = np.argsort(h, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
            count = np.diff(np.append(begin, len(h)))
            low = np.empty(len(h), np.int64)
            low[order] = np.repeat(np.minimum.reduceat(doc[order], begin), count)
            keep = doc > low
            if not last:
                high = np.empty(len(h), np.int64)
                high[order] = np.repeat(np.maximum.reduceat(doc[order], begin), count)
                keep = high > low
            doc, tag, pos = doc[keep], tag[keep], pos[keep]
        parts.append((doc, tag, pos))
    doc, tag, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    to = (mix(doc.astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((pos, tag, doc, to))
    to, doc, tag, pos = to[order], doc[order], tag[order], pos[order]
    out = {k: [] for k in ("bucket", "docs", "tags", "counts", "pos")}
    for at in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(to) else []:
        runs = at[_run_starts(doc[at], tag[at])]
        values = (int(to[at[0]]), doc[runs].tobytes(), tag[runs].tobytes(), np.diff(np.append(runs, at[-1] + 1)).astype(np.int32).tobytes(), pos[at].tobytes())
        for k, v in zip(out, values, strict=True):
            out[k].append(v)
    return pa.table({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()})


def _run_starts(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])[: len(doc)])


def _gather(table: pa.Table) -> pa.Table:
    """One row for each document of a bucket, with all its answers."""
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32)
    doc, tag = (np.repeat(np.frombuffer(b"".join(table[c].to_pylist()), t), counts) for c, t in (("docs", np.int64), ("tags", np.int32)))
    pos = np.frombuffer(b"".join(table["pos"].to_pylist()), np.uint32)
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos = doc[order], tag[order], pos[order]
    runs = _run_starts(doc, tag)
    packed = pa.array([x.tobytes() for x in np.split(pos, runs[1:])] if len(runs) else [], pa.binary())
    first = np.flatnonzero(np.concatenate([[True], np.diff(doc[runs]) != 0])[: len(runs)])
    marks = pa.ListArray.from_arrays(pa.array(np.append(first, len(runs)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(tag[runs], pa.int32()), packed], ["tag", "pos"]))
    return pa.table({"doc_id": pa.array(doc[runs[first]], pa.int64()), "marks": marks})


def _answerer(last: bool, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def one(table: pa.Table) -> pa.Table:
        return _answers(table, last, buckets)

    return one


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, first: int = FIRST_LEVEL) -> DataFrame | None:
    """(doc_id, marks: array of (tag, pos)): starts of the windows of ``min_words`` words that also start
    in a document with a smaller id; ``pos`` is packed 32-bit word numbers. None if there are none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    conf = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    buckets = max(int(conf), docs.rdd.getNumPartitions())
    marks, below = None, 0
    for n in levels(min_words, first):
        source = docs if marks is None else docs.join(marks, "doc_id")
        packets = source.mapInArrow(lambda x, a=below, b=n: _level(x, a, b, min_words, buckets), _PACKET)
        answers = packets.groupBy("bucket").applyInArrow(_answerer(n == min_words, buckets), _ANSWER)
        marks = written(answers.groupBy("bucket").applyInArrow(_gather, _MARKS), "repeats")
        if marks.isEmpty():
            return None
        below = n
    return marks


_REMOVED = "n_words long, n_removed long, kept string, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch], least: int, carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in row_blocks(batch, "text"):
            words = Words(rows["text"])
            starts = marked(words, row_tags(words, words.hashes()), rows["marks"].to_pylist())
            edge = np.zeros(len(words) + least + 1, np.int64)
            at = np.flatnonzero(starts)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + least, -1)
            keep = np.cumsum(edge)[: len(words)] == 0
            kept = joined_words(words, keep)
            size = np.diff(words.first)
            total = np.concatenate([[0], np.cumsum(keep)])
            left = total[words.first[1:]] - total[words.first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*(rows[c] for c in carry), pa.array(size, pa.int64()), pa.array(size - left, pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                names=[*carry, "n_words", "n_removed", "kept", "kept_sha256"],
            )


def joined_words(words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each row, joined by one space, as UTF-8."""
    start, size = words.start[keep], (words.end - words.start)[keep]
    at = np.cumsum(size + 1) - (size + 1)
    total = int((size + 1).sum())
    out = np.full(total, 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[inner + np.repeat(at, size)] = words.data[inner + np.repeat(start, size)]
    whole = out.tobytes()
    ends = np.append(at, total)
    first = np.concatenate([[0], np.cumsum(keep)])[words.first]
    return [whole[ends[a] : max(ends[a], ends[b] - 1)] for a, b in zip(first[:-1], first[1:], strict=True)]


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, first: int = FIRST_LEVEL, carry: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """One row for each of ``docs``: its columns ``carry`` (doc_id and text at least), n_words, n_removed, kept
    (words that stay, joined by one space) and kept_sha256 of its UTF-8 bytes."""
    marks = repeated_windows(docs, min_words, first)
    docs = docs.select(*carry).withColumn("doc_id", F.col("doc_id").cast("long"))
    if marks is None:
        docs = docs.withColumn("marks", F.lit(None).cast("array<struct<tag:int,pos:binary>>"))
    else:
        docs = docs.join(marks, "doc_id", "left")
    columns = [f.name for f in docs.schema if f.name != "marks"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "marks")
    return docs.mapInArrow(lambda x: _cut(x, min_words, columns), f"{schema}, {_REMOVED}")
