"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are escaped (dummy prefix, U+2581 for a space) and cut before each U+2581 that follows another
character: no piece of such a model reaches across that point, so the parts are encoded alone, each
distinct part of a block once. All parts are merged together: flat symbol arrays, in each round the
least pair rank of every part (a segmented minimum), all its places merged at once from the left,
then compaction of the arrays; parts without a pair left leave the arrays. Merging several places of
a part at once equals the library's one-by-one order unless the new symbols form a pair of the same or
a better rank; such a part takes its leftmost place alone in that round.

The model file is a parameter. The driver reads its pieces and scores through the library and
broadcasts the tables (bounded by the vocabulary, a few MB); encoding and decoding never call it.

Defined cases: null text counts as empty, which has no ids and decodes to the empty text. Characters
outside the vocabulary become byte pieces. Rows are independent, so copies, ties and repeated ids need
no care. An empty table gives an empty result. Only the named columns are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.words import flat, row_blocks

MODEL = "piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
SPACE = "▁"
_NONE = np.iinfo(np.int32).max


@dataclass
class Model:
    """Pieces by id, the id of each single character, byte pieces, and the pairs that merge."""

    pieces: list[bytes]  # as they decode: none for control pieces
    byte_ids: np.ndarray  # of the 256 bytes
    bytes_of: np.ndarray  # of each id: its byte, or -1
    char_ids: np.ndarray  # by code point; -1: not in the vocabulary
    pair_keys: np.ndarray  # left id * size + right id, sorted
    pair_ranks: np.ndarray  # 0: the best score
    pair_ids: np.ndarray  # the merged piece

    @property
    def size(self) -> int:
        return len(self.pieces)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def read_model(path: str) -> Model:
    """Tables of a BPE model with byte fallback whose normalizer keeps texts as they are."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    text = [sp.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any(sp.is_unused(i) for i in normal) or any(SPACE in text[i].lstrip(SPACE) for i in normal):
        raise ValueError("a model with unused pieces, or pieces that reach across a space, isn't supported")
    ids = {text[i]: i for i in normal}
    ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
    byte_ids, bytes_of = np.zeros(256, np.int32), np.full(n, -1, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            bytes_of[i] = int(text[i][3:5], 16)
            byte_ids[bytes_of[i]] = i
    char_ids = np.full(0x110000, -1, np.int32)
    pairs = []
    for piece, i in ids.items():
        if len(piece) == 1:
            char_ids[ord(piece)] = i
        for k in range(1, len(piece)):
            a, b = ids.get(piece[:k]), ids.get(piece[k:])
            if a is not None and b is not None:
                pairs.append((a * n + b, ranks[sp.get_score(i)], i))
    keys, rank, merged = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
    shown = ["" if sp.is_control(i) else " \u2047 " if sp.is_unknown(i) else x for i, x in enumerate(text)]
    return Model([x.encode() for x in shown], byte_ids, bytes_of, char_ids, keys, rank.astype(np.int32), merged.astype(np.int32))


def _ranks(model: Model, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged piece of each symbol with the next one; ``last``: whether it ends its part."""
    left = symbols.astype(np.int64)
    key = np.empty(len(symbols), np.int64)
    key[:-1] = left[:-1] * model.size + left[1:]
    key[:-1][(left[:-1] >= model.size) | (left[1:] >= model.size)] = -1
    key[-1:] = -1
    key[last] = -1
    at = np.searchsorted(model.pair_keys, key)
    at[at == len(model.pair_keys)] = 0
    hit = model.pair_keys[at] == key
    return np.where(hit, model.pair_ranks[at], _NONE), np.where(hit, model.pair_ids[at], -1)


def merge_rounds(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all parts, end to end, and the number of each part's symbols; merged until no pair is
    left. Symbols from ``model.size`` on stand for characters outside the vocabulary."""
    done_part, done_symbol, part = [], [], np.arange(len(sizes))
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes) - 1] = True
    rank, merged = _ranks(model, symbols, last)
    while len(symbols):
        begin = np.cumsum(sizes) - sizes
        best = np.minimum.reduceat(rank, begin)
        over = best == _NONE
        if over.any():  # these parts leave
            drop = np.repeat(over, sizes)
            done_part.append(np.repeat(part[over], sizes[over]))
            done_symbol.append(symbols[drop])
            stay = ~drop
            symbols, last, rank, merged = symbols[stay], last[stay], rank[stay], merged[stay]
            sizes, part, best = sizes[~over], part[~over], best[~over]
            if not len(symbols):
                break
            begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(rank == best[owner])
        run = np.concatenate([[True], np.diff(at) != 1])  # of places that touch, every second one merges
        at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        while True:
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            new_symbols, new_last = symbols.copy(), last.copy()
            new_symbols[at] = merged[at]
            new_last[at] = last[at + 1]
            new_symbols, new_last, new_owner = new_symbols[stay], new_last[stay], owner[stay]
            new_rank, new_merged = _ranks(model, new_symbols, new_last)
            gone = np.bincount(owner[at], minlength=len(sizes))
            new_sizes = sizes - gone
            new_best = np.minimum.reduceat(new_rank, np.cumsum(new_sizes) - new_sizes)
            early = (gone > 1) & (new_best <= best)
            if not early.any():
                break
            first = np.concatenate([[True], np.diff(owner[at]) != 0])
            at = at[first | ~early[owner[at]]]
        symbols, last, rank, merged, sizes = new_symbols, new_last, new_rank, new_merged, new_sizes
    part = np.concatenate(done_part) if done_part else np.empty(0, np.int64)
    symbols = np.concatenate(done_symbol) if done_symbol else np.empty(0, np.int32)
    order = np.argsort(part, kind="stable")
    return part[order], symbols[order]


def split_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Escaped texts cut into parts, end to end, and the offsets of each text's parts."""
    texts = pc.fill_null(texts, "")
    escaped = pc.replace_substring(texts, " ", SPACE)
    escaped = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", SPACE), escaped, "")
    data, offs = flat(escaped)
    a, b, c = SPACE.encode()
    mark = np.zeros(len(data), bool)
    if len(data) > 2:
        mark[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    begin = mark.copy()
    begin[3:] &= ~mark[:-3]
    begin[offs[:-1][offs[:-1] < len(data)]] = True
    at = np.flatnonzero(begin)
    bounds = np.append(at, len(data))
    parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return parts, np.searchsorted(at, offs)


def encode_parts(model: Model, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of escaped parts (not empty), end to end, and the n + 1 offsets of each part's ids."""
    data, offs = flat(parts)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    symbols = model.char_ids[points]
    symbols = np.where(symbols < 0, (points + np.uint32(model.size)).astype(np.int32), symbols)
    part, symbols = merge_rounds(model, symbols, np.diff(chars))
    strange = symbols >= model.size
    if strange.any():  # byte fallback
        code = symbols[strange] - model.size
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        each = np.ones(len(symbols), np.int64)
        each[strange] = width
        out = np.repeat(symbols, each)
        out[np.repeat(strange, each)] = model.byte_ids[raw]
        part, symbols = np.repeat(part, each), out
    return symbols, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(parts)))])


def decode_ids(model: Model, ids: np.ndarray) -> bytes:
    """The text of a sequence of ids, as UTF-8 (byte pieces that form no character become U+FFFD each)."""
    at = model.bytes_of[ids]
    text, run = [], bytearray()

    def flush() -> None:
        rest = bytes(run)
        while rest:
            for n in (1, 2, 3, 4):
                try:
                    rest[:n].decode()
                except UnicodeDecodeError:
                    continue
                break
            else:
                n = 0
            text.append(rest[:n] or "�".encode())
            rest = rest[n or 1 :]
        run.clear()

    for i, byte in zip(ids.tolist(), at.tolist(), strict=True):
        if byte >= 0:
            run.append(byte)
        else:
            flush()
            text.append(model.pieces[i])
    flush()
    whole = b"".join(text)
    return (whole[3:] if whole.startswith(SPACE.encode()) else whole).replace(SPACE.encode(), b" ")


def _decode_parts(model: Model, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Decoded text of each part, without the removal of the dummy prefix. Parts that were encoded hold
    whole characters, so they decode alone."""
    plain = pa.array([bytes([b]) if b >= 0 else p.replace(SPACE.encode(), b" ") for p, b in zip(model.pieces, model.bytes_of.tolist(), strict=True)], pa.large_binary())
    data, ends = flat_binary(plain.take(pa.array(ids)))
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(ends[offs].astype(np.int64)), pa.py_buffer(data)])


def flat_binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return np.ascontiguousarray(data[offs[0] : offs[-1]]), offs - offs[0]


def _tokenise(batches: Iterator[pa.RecordBatch], model: Model, carry: list[str], outputs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    numbers = pa.array([b"%d," % i for i in range(model.size)], pa.large_binary())
    for batch in batches:
        for rows in row_blocks(batch, "text", BLOCK_BYTES):
            parts, first = split_parts(rows["text"])
            coded = parts.dictionary_encode()
            known, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            ids, offs = encode_parts(model, known) if len(known) else (np.empty(0, np.int32), np.zeros(1, np.int64))
            size = np.diff(offs)
            total = np.concatenate([[0], np.cumsum(size[which])]) if len(which) else np.zeros(1, np.int64)
            n_tokens = total[first[1:]] - total[first[:-1]]
            out: list[pa.Array] = [pa.array(n_tokens, pa.int64())]
            for name in outputs:
                if name == "ids":
                    at = np.repeat(offs[:-1][which], size[which]) + np.arange(total[-1]) - np.repeat(total[:-1], size[which])
                    out.append(pa.ListArray.from_arrays(pa.array(total[first].astype(np.int32)), pa.array(ids[at].astype(np.int32))))
                elif name == "ids_sha256":
                    shown, ends = flat_binary(numbers.take(pa.array(ids)))
                    shown = pa.Array.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(ends[offs].astype(np.int64)), pa.py_buffer(shown)])
                    out.append(_digests(shown, which, first, 0, 1))
                elif name == "decoded_sha256":
                    out.append(_digests(_decode_parts(model, ids, offs), which, first, 1, 0))
                else:
                    data, ends = flat_binary(_decode_parts(model, ids, offs).take(pa.array(which)))
                    whole = data.tobytes()
                    out.append(pa.array([whole[a + 1 : b].decode() if b > a else "" for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in carry), *out], names=[*carry, "n_tokens", *outputs])


def _digests(known: pa.Array, which: np.ndarray, first: np.ndarray, skip: int, cut: int) -> pa.Array:
    data, ends = flat_binary(known.take(pa.array(which)))
    whole = memoryview(data)
    return pa.array([hashlib.sha256(whole[a + skip : b - cut] if b > a else b"").hexdigest() for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist(), strict=True)], pa.string())


_KINDS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def tokenise(docs: DataFrame, model_path: str | None = None, carry: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode the column ``text`` of every row and decode the ids: the columns ``carry``, n_tokens, and of ids,
    decoded, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 those in ``outputs``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(model_path or default_model()))
    source = docs.select(*dict.fromkeys((*carry, "text")))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "n_tokens long", *(f"{o} {_KINDS[o]}" for o in outputs)])
    return source.mapInArrow(lambda x: _tokenise(x, model.value, list(carry), outputs), schema)


def detokenise(rows: DataFrame, model_path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decode the column ``ids`` (array<int>; null: none) of every row: the columns ``carry`` and decoded."""
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(read_model(model_path or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [decode_ids(model.value, np.array(x or [], np.int64)).decode() for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in carry), pa.array(text, pa.string())], names=[*carry, "decoded"])

    source = rows.select(*dict.fromkeys((*carry, "ids")))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.withColumn("ids", F.col("ids").cast("array<int>")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "decoded string"]))
