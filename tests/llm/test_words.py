import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mixclust.llm.words import Words, inside, row_blocks, sliding, windows

from .conftest import LOWER, WORD

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é漢\t\n  ", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans(), st.integers(1, 6))
def test_words_and_windows(texts, lower, n):
    words = Words(pa.array(texts, pa.string()), lower)
    ids, data = words.hashes(), words.data.tobytes()
    known = {}
    found = [[data[a:b].decode() for a, b in zip(words.start[x:y], words.end[x:y])] for x, y in zip(words.first[:-1], words.first[1:])]
    assert found == [WORD.findall(t or "") for t in texts]
    plain = [w.translate(LOWER) if lower else w for row in found for w in row]
    for w, h in zip(plain, ids.tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    g, ok, seen = windows(ids, n), inside(words, n), {}
    for i in range(len(g)):
        assert ok[i] == (words.row[i] == words.row[i + n - 1])
        assert seen.setdefault(tuple(plain[i : i + n]), g[i]) == g[i]
    assert len(set(seen.values())) == len(seen)


def test_slices_of_a_column_and_blocks():
    col = pa.array(["aa b", None, "", "c d e", "f"])
    batch = pa.RecordBatch.from_arrays([col], names=["text"]).slice(1, 4)
    assert len(Words(batch["text"])) == 4
    assert [b.num_rows for b in row_blocks(batch, "text", 1)] == [2, 1, 1] or sum(b.num_rows for b in row_blocks(batch, "text", 1)) == 4
    assert Words(pa.array(["x" * 40_000, "x" * 40_000 + "y"])).hashes()[0] != Words(pa.array(["x" * 39_999])).hashes()[0]


@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 9), st.booleans())
def test_sliding(x, n, least):
    got = sliding(np.array(x, np.int64), n, least).tolist()
    assert got == [(min if least else max)(x[i : i + n]) for i in range(len(x) - n + 1)]
