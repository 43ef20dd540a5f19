import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mixclust.llm.pseudo_likelihood import (BUCKETS, KNOWN, N_VALUES, SIDE, TOKENS, _mean, contexts, log_probabilities, new_model, parts_of, score, score_corpus,
                                            tokens_of, train, train_on, vocabulary, word_counts)
from mixclust.llm.queries import QUERIES
from mixclust.llm.words import Words

from .conftest import SF, WORD, sentence


def test_contexts_stay_within_texts():
    words = Words(pa.array(["a b c", None, "d", "e f"]))
    x = contexts(words, np.arange(6))
    t = TOKENS
    assert SIDE == 2 and x.tolist() == [[t, t, 1, 2], [t, 0, 2, t], [0, 1, t, t], [t, t, t, t], [t, t, 5, t], [t, 4, t, t]]


def test_probabilities_add_up_and_training_lowers_the_loss():
    model = new_model()
    context = np.tile([[1, 2, 3, 4]], (TOKENS, 1))
    assert np.exp(log_probabilities(parts_of(model), np.arange(TOKENS), context)).sum() == pytest.approx(1, abs=1e-3)
    rng = np.random.default_rng(0)
    token = rng.integers(0, 6, 20_000)
    words = Words(pa.array([" ".join("w" * (1 + i) for i in token)]))
    token[2::3] = (token[1::3][: len(token[2::3])] + 1) % 6  # every third follows from the one before
    near = contexts(words, token)
    before = log_probabilities(parts_of(model), token, near).mean()
    for _ in range(3):
        train_on(model, np.full(N_VALUES, 1e-7, np.float32), token, near, 0.1, rng)
    after = log_probabilities(parts_of(model), token, near)
    assert after.mean() > before + 3 and after.mean() > math.log(1 / 6)  # better than without the context


def test_gradient_step_matches_differences():
    rng = np.random.default_rng(3)
    model, token, near = new_model(), rng.integers(0, TOKENS, 50), rng.integers(0, TOKENS, (50, 4))
    loss = lambda m: -log_probabilities(parts_of(m.astype(np.float64)), token, near).mean()
    squares, stepped = np.zeros(N_VALUES, np.float32) + 1e-30, model.copy()
    train_on(stepped, squares, token, near, 1e-4, np.random.default_rng(0))
    size = np.sqrt(squares)
    for i in np.argsort(-size)[:40:8]:
        up, down = model.astype(np.float64), model.astype(np.float64)
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4
        assert abs(slope) == pytest.approx(size[i], rel=0.05) and np.sign(stepped[i] - model[i]) == -np.sign(slope)


def test_means_are_weighted_by_tokens():
    xs = [np.arange(4, dtype=np.float32), np.ones(4, np.float32)]
    t = pa.table({"slice": pa.array([0, 0], pa.int32()), "part": pa.array([1, 0], pa.int32()), "tokens": [3, 1], "x": [x.tobytes() for x in xs]})
    out = _mean(("slice",))(t)
    assert out["tokens"][0].as_py() == 4 and np.allclose(np.frombuffer(out["x"][0].as_py(), np.float32), (xs[0] * 3 + xs[1]) / 4)


def test_counts_over_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = Counter(w for r in docs.collect() for w in WORD.findall(r.text or ""))
    rows = {np.uint64(r.word & (2**64 - 1)): r.n for r in word_counts(docs).collect()}
    names = list(plain)
    hashes = Words(pa.array([" ".join(names)])).hashes()
    assert {h: plain[w] for h, w in zip(hashes, names)} == rows
    words, tokens = vocabulary(docs)
    known = tokens_of(hashes, words, tokens)
    assert len(words) == KNOWN and (known < TOKENS).all() and ((known >= KNOWN) == (np.array([h not in set(words.tolist()) for h in hashes.tolist()]))).all()
    assert known[names.index(plain.most_common(1)[0][0])] == 0 and TOKENS - KNOWN == BUCKETS


def test_query_beats_word_frequencies(spark):
    rows = QUERIES["op9_lm_scoring"](spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    count = Counter(w for some in words.values() for w in some)
    assert {r.doc_id: r.n_tokens for r in rows} == {d: len(some) for d, some in words.items()}
    n = np.array(list(count.values()), float)
    unigram = float((n * np.log(n / n.sum())).sum() / n.sum())
    assert sum(r.log_likelihood for r in rows) / n.sum() > unigram + 0.1
    assert all(r.log_likelihood < 0 and r.mean_log_likelihood == pytest.approx(r.log_likelihood / r.n_tokens) for r in rows if r.n_tokens)


def test_rough_documents(spark, rough, none):
    out = score_corpus(rough).collect()
    assert len(out) == rough.count()
    by = {r.doc_id: r for r in out}
    assert (by[4].n_tokens, by[4].log_likelihood, by[4].mean_log_likelihood) == (0, 0.0, None) == (by[6].n_tokens, by[6].log_likelihood, by[6].mean_log_likelihood)
    assert by[1].log_likelihood == pytest.approx(by[2].log_likelihood, rel=1e-6) and by[11].n_tokens == 20_000
    assert score_corpus(none).collect() == []


def test_training_is_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vocab = vocabulary(docs)
    a, b = train(docs, vocab), train(docs, vocab)
    assert np.array_equal(a, b)
    assert score(docs, vocab, a).count() == docs.count()


def test_every_word_has_its_own_probability(spark):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(KNOWN)]
    rows = [(d, " ".join(common * 4)) for d in range(3)]
    rows += [(10 + d, sentence(rng, 300)) for d in range(20)] + [(50, "often " * 9), (51, "seldom"), (52, ""), (None, "seldom often c1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocab, model = vocabulary(docs), new_model()
    probe = spark.createDataFrame([*rows, (60, "garbled0"), (61, "often seldom garbled0")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in score(probe, vocab, model, word_counts(docs)).collect()}
    count = Counter(w for _, t in rows for w in t.split())
    name = {w: int(h) for w, h in zip(count, Words(pa.array([" ".join(count)])).hashes().tolist())}
    known = set(vocab[0].tolist())
    n, kinds = Counter(), Counter()
    for w, k in count.items():
        if name[w] not in known:
            n[name[w] % BUCKETS] += k
            kinds[name[w] % BUCKETS] += 1
    name["garbled0"] = int(Words(pa.array(["garbled0"])).hashes()[0])
    assert len(got) == len(rows) + 2 and name["seldom"] not in known and len(n) > 100
    for d, text in [*rows, (60, "garbled0"), (61, "often seldom garbled0")]:
        words = Words(pa.array([text]))
        token = tokens_of(words.hashes(), *vocab)
        expected = log_probabilities(parts_of(model), token, contexts(words, token)).sum()
        for w in text.split():
            if (h := name[w]) not in known:
                expected += math.log((count[w] + 0.5) / (n[h % BUCKETS] + 0.5 * (kinds[h % BUCKETS] + 1)))
        assert got[d].log_likelihood == pytest.approx(expected, rel=1e-6, abs=1e-9) and got[d].n_tokens == len(text.split())


def test_query_beats_the_frequencies_of_all_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = score_corpus(docs).collect()
    count = Counter(w for r in docs.collect() for w in WORD.findall(r.text or ""))
    n = np.array(list(count.values()), float)
    assert sum(r.log_likelihood for r in rows) / n.sum() > float((n * np.log(n / n.sum())).sum() / n.sum())
