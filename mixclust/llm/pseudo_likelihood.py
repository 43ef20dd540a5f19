"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from the two before and the two after it: embeddings
of the four, one hidden layer, and a softmax in two levels (class of the token, token in its class). A
document's score is the sum of its words' conditional log-probabilities.

The network's tokens are the KNOWN most frequent words of the whole corpus (counts are gathered over all
documents) and, for the others, one of BUCKETS hash buckets. A word of a bucket has the bucket's probability by
the network, times the word's own share of its bucket by the counts of the whole corpus; UNSEEN is added to
each count, and once for all words that the corpus lacks. The counts stay a table: each task asks once for each
distinct word of a block of documents, in packets by hash of the word, and adds up the answers by block.

Training goes over every token of the corpus once, in ROUNDS
rounds of documents chosen by a hash of their id: each task starts from the round's model, trains on its
documents with Adagrad, and the models are averaged, weighted by tokens, slice by slice and in two steps, so no
task takes in more than about the square root of the tasks' models at once. The driver holds one model.

Defined cases: null text counts as empty; a text without words has the sum 0 and no mean; copies train and
score like any other rows; a null doc_id is carried; an empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.words import Words, row_blocks
from mixclust.session import written

CLASSES, IN_CLASS, BUCKETS = 40, 40, 256
TOKENS = CLASSES * IN_CLASS
KNOWN = TOKENS - BUCKETS
SIDE, WIDTH, HIDDEN = 2, 12, 24
ROUNDS, BATCH, RATE, FIRST_SQUARE = 4, 8192, 0.1, 1e-7
SLICES = 16
UNIQUES = 1 << 22  # distinct words that a task holds before it sends their counts on
UNSEEN = 0.5  # added to each word's count in its bucket
HELD = 1 << 21  # rows and words of buckets in a block of documents

#: Names and shapes of the model's parts; the embedding of the number TOKENS stands outside a text.
SHAPES = {"E": (TOKENS + 1, WIDTH), "W": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "C": (HIDDEN, CLASSES), "c": (CLASSES,), "T": (CLASSES, HIDDEN, IN_CLASS), "t": (CLASSES, IN_CLASS)}
N_VALUES = sum(math.prod(s) for s in SHAPES.values())


def parts_of(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of a model's parts in its flat array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def new_model(seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.zeros(N_VALUES, np.float32)
    for name, x in parts_of(flat).items():
        if x.ndim > 1:
            x[:] = rng.normal(0, 0.1 if name == "E" else 1 / math.sqrt(x.shape[-2]), x.shape)
    return flat


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the hash of each distinct word of all texts and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, count = np.empty(0, np.uint64), np.empty(0, np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "n"])

        for batch in batches:
            for rows in row_blocks(batch, "text"):
                w, n = np.unique(Words(rows["text"]).hashes(), return_counts=True)
                word, which = np.unique(np.concatenate([word, w]), return_inverse=True)
                count = np.bincount(which, np.concatenate([count, n]), len(word)).astype(np.int64)
                if len(word) >= UNIQUES:
                    yield sent()
                    word, count = word[:0], count[:0]
        yield sent()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the KNOWN most frequent words, sorted, and their tokens (0: the most frequent)."""
    top = (word_counts(docs) if counts is None else counts).orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], order


def tokens_of(ids: np.ndarray, words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The token of each word hash."""
    out = (KNOWN + ids % np.uint64(BUCKETS)).astype(np.int64)
    if len(words):
        at = np.searchsorted(words, ids)
        at[at == len(words)] = 0
        hit = words[at] == ids
        out[hit] = tokens[at[hit]]
    return out


def contexts(words: Words, tokens: np.ndarray) -> np.ndarray:
    """The SIDE tokens before and after each token of its text."""
    padded = np.full(len(tokens) + 2 * SIDE * len(words.offs), TOKENS, np.int64)
    place = np.arange(len(tokens)) + 2 * SIDE * words.row + SIDE
    padded[place] = tokens
    return np.stack([padded[place + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1)


def _log_p(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row's scores at one place."""
    top = x.max(1)
    return x[np.arange(len(x)), at] - top - np.log(np.exp(x - top[:, None]).sum(1))


def _error(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gradient of -log-softmax at one place by the scores: softmax, less 1 at the place."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    x[np.arange(len(x)), at] -= 1
    return x


def _by_class(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(classes.astype(np.uint16), kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=CLASSES))])
    for c in range(CLASSES):
        if edges[c] < edges[c + 1]:
            yield c, order[edges[c] : edges[c + 1]]


def log_probabilities(p: dict[str, np.ndarray], token: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log p(token | context) of each row."""
    out = np.empty(len(token), np.float64)
    for at in range(0, len(token), BATCH * 4):
        t, x = token[at : at + BATCH * 4], p["E"][context[at : at + BATCH * 4]].reshape(-1, 2 * SIDE * WIDTH)
        h = np.tanh(x @ p["W"] + p["b"])
        klass, inner = np.divmod(t, IN_CLASS)
        own = _log_p(h @ p["C"] + p["c"], klass)
        for c, rows in _by_class(klass):
            own[rows] += _log_p(h[rows] @ p["T"][c] + p["t"][c], inner[rows])
        out[at : at + len(t)] = own
    return out


def train_on(flat: np.ndarray, squares: np.ndarray, token: np.ndarray, context: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """One pass of Adagrad over the rows, in place."""
    p = parts_of(flat)
    order = rng.permutation(len(token))
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        t, near = token[some], context[some]
        x = p["E"][near].reshape(-1, 2 * SIDE * WIDTH)
        h = np.tanh(x @ p["W"] + p["b"])
        klass, inner = np.divmod(t, IN_CLASS)
        gradient = np.zeros_like(flat)
        g = parts_of(gradient)
        d = _error(h @ p["C"] + p["c"], klass)
        g["C"][:], g["c"][:] = h.T @ d, d.sum(0)
        dh = d @ p["C"].T
        for c, rows in _by_class(klass):
            own = h[rows]
            d = _error(own @ p["T"][c] + p["t"][c], inner[rows])
            g["T"][c], g["t"][c] = own.T @ d, d.sum(0)
            dh[rows] += d @ p["T"][c].T
        dh *= 1 - h * h
        g["W"][:], g["b"][:] = x.T @ dh, dh.sum(0)
        dx = (dh @ p["W"].T).reshape(-1, WIDTH)
        key = np.argsort(near.ravel().astype(np.uint16), kind="stable")
        ids = near.ravel()[key]
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        g["E"][ids[begin]] = np.add.reduceat(dx[key], begin)
        gradient /= len(t)
        squares += gradient * gradient
        flat -= rate * gradient / np.sqrt(squares)


def _mean(keys: tuple[str, ...]) -> Callable[[pa.Table], pa.Table]:
    def one(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["part"].to_pylist(), t["tokens"].to_pylist(), t["x"].to_pylist(), strict=True))
        n = sum(r[1] for r in rows)
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) * (k / n) for _, k, x in rows)
        out = {k: [t[k][0].as_py()] for k in keys} | {"part": [rows[0][0]], "tokens": [n], "x": [total.astype(np.float32).tobytes()]}
        return pa.table(out, schema=pa.schema([(k, pa.int32()) for k in (*keys, "part")] + [("tokens", pa.int64()), ("x", pa.binary())]))

    return one


def train(docs: DataFrame, vocab: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """A model trained on every token of ``docs`` once."""
    spark = docs.sparkSession
    flat = new_model(seed)
    lanes = math.isqrt(max(1, docs.rdd.getNumPartitions())) + 1
    words = spark.sparkContext.broadcast(vocab)
    for k in range(rounds):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            part, model, squares, n = TaskContext.get().partitionId(), start.value.copy(), np.full(N_VALUES, FIRST_SQUARE, np.float32), 0
            for batch in batches:
                for rows in row_blocks(batch, "text"):
                    found = Words(rows["text"])
                    token = tokens_of(found.hashes(), *words.value)
                    train_on(model, squares, token, contexts(found, token), RATE / (1 + k), np.random.default_rng([seed, k, part, n]))
                    n += len(token)
            if n:
                slices = [x.tobytes() for x in np.array_split(model, SLICES)]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part % lanes] * SLICES, pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(slices, pa.binary())], names=["slice", "lane", "part", "tokens", "x"])

        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("text")
        models = some.mapInArrow(run, "slice int, lane int, part int, tokens long, x binary")
        models = models.groupBy("slice", "lane").applyInArrow(_mean(("slice", "lane")), "slice int, lane int, part int, tokens long, x binary")
        models = models.groupBy("slice").applyInArrow(_mean(("slice",)), "slice int, part int, tokens long, x binary")
        if got := sorted((r["slice"], bytes(r["x"])) for r in models.select("slice", "x").collect()):  # one model
            flat = np.concatenate([np.frombuffer(x, np.float32) for _, x in got])
    return flat


def bucket_totals(counts: DataFrame, vocab: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and distinct words in each of the BUCKETS."""
    sent = counts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(TOKENS), np.zeros(TOKENS, np.int64)
        for b in batches:
            token = tokens_of(b["word"].to_numpy().view(np.uint64), *sent.value)
            n += np.bincount(token, b["n"].to_numpy(), TOKENS)
            words += np.bincount(token, minlength=TOKENS)
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.arange(BUCKETS), n[KNOWN:].astype(np.int64), words[KNOWN:]), kinds, strict=True)], names=["bucket", "n", "words"])

    n, words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in counts.mapInArrow(run, "bucket int, n long, words long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        n[r["bucket"]], words[r["bucket"]] = r["n"], r["words"]
    return n, words


_BLOCK = "block long, packet int, x binary, doc_ids array<bigint>, sizes array<bigint>, totals array<double>, rare array<bigint>"


def _by_packet(words: np.ndarray, packets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the words by packet, the packets that occur, and where each begins in the order (and the end)."""
    to = ((words >> np.uint64(16)) % np.uint64(packets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    names, begin = np.unique(to[order], return_index=True)
    return order, names, np.append(begin, len(words))


def _packed(held: list, block: int, packets: int) -> pa.RecordBatch:
    """A row for a block's documents (packet -1; ``x``: places of their bucket words among the block's distinct
    ones, in order of packets), and a row of distinct words for each packet."""
    doc_ids, sizes, totals, rare, ids = zip(*held, strict=True)
    words, place = np.unique(np.concatenate(ids), return_inverse=True)
    order, names, begin = _by_packet(words, packets)
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words))
    words, none = words[order], [None] * len(names)
    x = [rank[place].tobytes(), *(words[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True))]
    whole = [pa.concat_arrays(doc_ids).to_pylist(), *(np.concatenate(c) for c in (sizes, totals, rare))]
    columns = [pa.array([block] * len(x), pa.int64()), pa.array([-1, *names.tolist()], pa.int32()), pa.array(x, pa.binary())]
    columns += [pa.array([c, *none], pa.list_(t)) for c, t in zip(whole, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "packet", "x", "doc_ids", "sizes", "totals", "rare"])


def _count_packets(batches: Iterator[pa.RecordBatch], packets: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def sent() -> pa.RecordBatch:
        word, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order, names, begin = _by_packet(word, packets)
        cut = [[c[order[a:b]].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)] for c in (word, n)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(c, pa.binary()) for c in cut)], names=["packet", "x", "n"])

    for b in batches:
        held.append((b["word"].to_numpy().view(np.uint64), b["n"].to_numpy()))
        size += b.num_rows
        if size >= UNIQUES:
            yield sent()
            held, size = [], 0
    if size:
        yield sent()


def _shares(n: np.ndarray, words: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """From the rows of one packet (counts, and the words that blocks ask for): log p(word | its bucket)."""
    whole = np.log(np.maximum(n + UNSEEN * (words + 1), UNSEEN))

    def one(t: pa.Table) -> pa.Table:
        known, asked = t.filter(pc.is_valid(t["n"])), t.filter(pc.is_null(t["n"]))
        word, count = (np.frombuffer(b"".join(known[c].to_pylist()), k) for c, k in (("x", np.uint64), ("n", np.int64)))
        order = np.argsort(word)
        word, count = np.append(word[order], np.uint64(0)), np.append(count[order], 0)
        out = []
        for x in asked["x"].to_pylist():
            ids = np.frombuffer(x, np.uint64)
            at = np.searchsorted(word[:-1], ids)
            own = np.where((word[at] == ids) & (at < len(word) - 1), count[at], 0)
            out.append((np.log(own + UNSEEN) - whole[(ids % np.uint64(BUCKETS)).astype(np.int64)]).tobytes())
        return pa.table({"block": asked["block"], "packet": asked["packet"], "x": pa.array(out, pa.binary())})

    return one


_SCORED = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"


def _added(t: pa.Table) -> pa.Table:
    """The documents of one block with their words' shares added."""
    head, answers = t.filter(pc.equal(t["packet"], -1)), t.filter(pc.greater_equal(t["packet"], 0)).sort_by("packet")
    share = np.frombuffer(b"".join(answers["x"].to_pylist()), np.float64)
    place = np.frombuffer(head["x"][0].as_py(), np.int32)
    n, total, rare = (head[c][0].values.to_numpy() for c in ("sizes", "totals", "rare"))
    total = total + np.bincount(np.repeat(np.arange(len(n)), rare), share[place], len(n))
    mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
    return pa.table({"doc_id": head["doc_ids"][0].values, "n_tokens": pa.array(n, pa.int64()), "log_likelihood": pa.array(total), "mean_log_likelihood": mean})


def score(docs: DataFrame, vocab: tuple[np.ndarray, np.ndarray], model: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum) and mean_log_likelihood of every row; ``counts``: the corpus's
    word counts (none: those of ``docs``)."""
    spark = docs.sparkSession
    counts = written(word_counts(docs), "word-counts") if counts is None else counts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    sent = spark.sparkContext.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = sent.value
        p, block, held, size = parts_of(flat), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for rows in row_blocks(batch, "text"):
                found = Words(rows["text"])
                ids = found.hashes()
                token = tokens_of(ids, *vocab)
                total = np.bincount(found.row, log_probabilities(p, token, contexts(found, token)), rows.num_rows)
                rare = token >= KNOWN
                held.append((rows["doc_id"], np.diff(found.first), total, np.bincount(found.row[rare], minlength=rows.num_rows), ids[rare]))
                size += rows.num_rows + int(rare.sum())
                if size >= HELD:
                    yield _packed(held, block, packets)
                    block, held, size = block + 1, [], 0
        if held:
            yield _packed(held, block, packets)

    blocks = written(docs.mapInArrow(run, _BLOCK), "blocks")
    asked = blocks.where("packet >= 0").select("block", "packet", "x", F.lit(None).cast("binary").alias("n"))
    known = counts.select("word", "n").mapInArrow(lambda b: _count_packets(b, packets), "packet int, x binary, n binary")
    known = known.select(F.lit(None).cast("long").alias("block"), "packet", "x", "n")
    shares = asked.unionByName(known).groupBy("packet").applyInArrow(_shares(*bucket_totals(counts, vocab)), "block long, packet int, x binary")
    return blocks.where("packet < 0").unionByName(shares, allowMissingColumns=True).groupBy("block").applyInArrow(_added, _SCORED)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Gather the words of ``docs``, train on all of them and score each."""
    counts = written(word_counts(docs), "word-counts")
    vocab = vocabulary(docs, counts)
    return score(docs, vocab, train(docs, vocab), counts)
