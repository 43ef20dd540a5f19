import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from mixclust.llm.queries import QUERIES
from mixclust.llm.sentencepiece_bpe import _tokenise, decode_ids, default_model, detokenise, read_model, tokenise

from .conftest import SF

MODEL = read_model(default_model())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=default_model())


def same(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for out in _tokenise(iter([batch]), MODEL, [], ("ids", "decoded")):
        rows = out.to_pylist()
    for text, r in zip(texts, rows, strict=True):
        ids = LIBRARY.encode(text or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == LIBRARY.decode(ids) == decode_ids(MODEL, np.array(ids, np.int64)).decode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghij the\u2581  \n\t.,=-0123\u00e9\u00df\u6f22\U0001f600\x00", max_size=60), min_size=1, max_size=8))
def test_random_texts(texts):
    same(texts)


def test_runs_strange_characters_and_long_texts():
    rng = random.Random(4)
    same([None, "", " ", "   x", "\u2581", "a" * 3000, " " * 200, "=-" * 900, "-" * 1000, "ab" * 1500, "<s></s><0x0A><unk>", "\x00\x7f", "\ufeff\ufb01", "".join(rng.choice("etaoin shrdlu") for _ in range(60_000))])


def test_decoding_of_any_ids():
    rng = random.Random(5)
    pool = [0, 1, 2, 3 + 0xE6, 3 + 0xBC, 3 + 0xA2, 3 + 0x41, 3 + 0xF0, 3 + 0x9F, 500, 600, 29871]
    for _ in range(1500):
        ids = [rng.choice(pool[1:]) for _ in range(rng.randint(0, 8))]
        assert decode_ids(MODEL, np.array(ids, np.int64)).decode() == LIBRARY.decode(ids)


def test_rough_documents(spark, rough, none):
    out = tokenise(rough, carry=("doc_id", "text"))
    for r in out.collect():
        ids = LIBRARY.encode(r.text or "")
        assert (r.ids, r.decoded) == (ids, LIBRARY.decode(ids))
    back = {(r.doc_id, r.decoded) for r in detokenise(out).collect()}
    assert back == {(r.doc_id, r.decoded) for r in out.collect()}
    assert tokenise(none).collect() == [] and detokenise(tokenise(none)).collect() == []


def test_query(spark):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = LIBRARY.encode(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        read_model(str(tmp_path / "none.model"))
