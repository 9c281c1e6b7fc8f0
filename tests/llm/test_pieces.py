import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from public_tokenizers import path

from llm_helpers import SF

from tidemark.llm import words_cache
from tidemark.llm.pieces import PieceModel, _backend, _encoded, _Pieces, read_model, with_pieces, with_text

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = [
    None, "", " ", "  ", "  a  b ", "Hello world, hello wörld.\n\n tabs\t", "日本語 \U0001f600 ñandú", "<s> x </s> <unk>",
    "x" * 3000 + " " + "y z " * 4000, "\x00\x01\x7f", "▁ a▁▁b ▁", "a b 　c", "1 22 333\r\n",
]


def message(*fields):
    """A protobuf message of (number, value) fields: ints as varints, floats as 32 bits, bytes with their length."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model(byte_fallback=True, trim=0):
    """A small hand-made unigram model; nothing is trained."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁the", "▁th", "e", "▁", "t", "h", "ing", "i", "n", "g", "▁▁", "wor", "ld", "w", "o", "r", "l", "d", "▁a", "a", "é", "s"]
    pieces += [(w, -2.0 - 0.37 * k, 1) for k, w in enumerate(words)]
    fields = [(1, message((1, text.encode()), (2, score), (3, kind))) for text, score, kind in pieces]
    trainer = message((3, 1), (35, int(byte_fallback)), (40, 0), (41, 1), (42, 2))
    normaliser = message((1, b"identity"), (3, 1), (4, trim), (5, 1))
    return message(*fields, (2, trainer), (3, normaliser))


@pytest.mark.parametrize("model", [read_model(path("piece_bpe_32k.model")), unigram_model(), unigram_model(False), unigram_model(True, 1)])
def test_parity_with_the_original(model):
    texts = [t or "" for t in TEXTS] + ["the thing  things a world", "  the é ü s"]
    got = _encoded(texts, model, True)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts)
    assert got.field("ids").to_pylist() == theirs
    assert got.field("parity").to_pylist() == [True] * len(texts)


def test_word_cache_gives_what_the_whole_text_gives():
    pieces = _backend(read_model(path("piece_bpe_32k.model")))
    assert pieces.by_words
    texts = [t or "" for t in TEXTS]
    for whole, raw in zip(pieces.backend.encode_batch_fast(texts, add_special_tokens=False), pieces.encode(texts)[0], strict=True):
        assert whole.ids == np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("model", [read_model(path("piece_bpe_32k.model")), unigram_model(), unigram_model(False)])
@pytest.mark.parametrize("entries", [3, 1 << 17])
def test_words_come_back_as_whole_texts_do(monkeypatch, model, entries):
    """`round_trip` from words against the library's decoder on whole texts, with a cache that holds next to nothing too."""
    monkeypatch.setattr(words_cache, "MOST_ENTRIES", entries)
    pieces = _Pieces(model)
    assert pieces.by_words
    docs = [r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()]
    for texts in ([t or "" for t in TEXTS], ["the thing  things a world", "  the é ü s", "the th"], [t or "" for t in docs], [t or "" for t in TEXTS]):
        raw, back = pieces.encode(texts)
        ids = [np.frombuffer(r, "<u4").tolist() for r in raw]
        assert ids == [e.ids for e in pieces.backend.encode_batch_fast(texts, add_special_tokens=False)]
        decoded = pieces.backend.decode_batch(ids, skip_special_tokens=False)
        assert back == [a == b for a, b in zip(decoded, texts, strict=True)]


def test_rows_round_trip(spark):
    model = read_model(path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] * 2, "doc_id INT, text STRING, pieces INT")
    rows = with_pieces(docs, model).collect()
    assert len(rows) == 2 * len(TEXTS)
    for row in rows:
        p = row.pieces
        assert p.n_tokens == len(p.ids) and p.parity and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4"))
        assert p.round_trip == ("▁" not in (row.text or ""))
    back = with_text(with_pieces(docs, model).select("doc_id", "text", "pieces.ids"), model, out="again").collect()
    assert all(r.again == (r.text or "") for r in back if "▁" not in (r.text or ""))
    assert with_pieces(docs.limit(0), model).collect() == []


def test_broken_models_are_refused():
    with pytest.raises(ValueError):
        PieceModel.parse(b"\x0a\xff\x01abc")
    with pytest.raises(ValueError):
        PieceModel.parse(b"")
    assert _encoded([], read_model(path("piece_bpe_32k.model")), True).type == pa.array(_encoded([], unigram_model(), False)).type
