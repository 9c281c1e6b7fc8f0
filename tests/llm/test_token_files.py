import json
import gc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_helpers import SF
from public_tokenizers import path
from tokenizers import Tokenizer

from tidemark.llm import token_files, words_cache
from tidemark.llm.perfect_hash import PerfectHash, fingerprints
from tidemark.llm.token_files import _ByteLevel, _byte_level, library_encoder, look_up, read_token_files, write_token_files
from tidemark.llm.words_cache import parts_before_words

FILE = path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a  b", "a \n b", "\n a", "one two  three\t four ", "it's don't 'tis", "<|endoftext|> x <|endoftext|>",
    "日本 語 é  x　 y", "w" * 5000 + " x" * 3000, "\x1c \x1d y", "end ",
]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_perfect_hash_numbers_every_key_once(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    hashed = PerfectHash.build(keys)
    assert sorted(hashed.number(keys)) == list(range(len(keys)))
    others = np.arange(1000) * 7919 + 5
    assert ((hashed.number(others) >= -1) & (hashed.number(others) < max(1, len(keys)))).all()
    assert len(np.unique(fingerprints(keys))) == len(keys)


def test_cutting_before_words_changes_no_id():
    whole = Tokenizer.from_file(FILE)
    with open(FILE, encoding="utf-8") as file:
        definition = file.read()
    assert _byte_level(definition).by_words and not _byte_level(json.dumps({**json.loads(definition), "normalizer": {"type": "NFC"}})).by_words
    got = library_encoder(definition, 0)(pa.array(TEXTS))
    for text, ids in zip(TEXTS, got, strict=True):
        assert ids.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert " ".join(parts_before_words(text or "")) == (text or "")


def characters():
    def encode(column):
        return [np.array([*map(ord, t or ""), 0], np.uint32) for t in column.to_pylist()]

    return encode


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, start INT")


@pytest.mark.parametrize("largest", [60_000, 2_000_000])
def test_files_read_back(spark, tmp_path, largest):
    rows = [(i * 7 % 101, t, 1) for i, t in enumerate(TEXTS * 9)] + [(None, "null key", 1), (None, None, 1), (5, "again", 2), (5, "again", 2)]
    rows = [r for r in rows if largest > 60_000 or "\U0001f600" not in (r[1] or "")]
    manifest = write_token_files(make(spark, rows).repartition(3), str(tmp_path / "t"), characters(), largest)
    back = read_token_files(manifest).orderBy("start").collect()
    assert len(back) == len(rows)
    known = [r.doc_id for r in back if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in back[-2:]] == [None, None]
    at = 0
    for r in back:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        at += r.n_tokens
    want = sorted(((r[0] is None, r[0] or 0, [*map(ord, r[1] or ""), 0]) for r in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in back) == want

    asked = spark.createDataFrame([(5,), (5,), (77,), (10_000,), (-3,), (None,)], "doc_id BIGINT")
    found = sorted((r.key, r.ids) for r in look_up(spark, manifest, asked).collect())
    assert found == sorted((k, ids) for none, k, ids in want if not none and k in (5, 77))


def test_empty_table(spark, tmp_path):
    manifest = write_token_files(make(spark, [(1, "", 1)]).limit(0), str(tmp_path / "e"), characters(), 60_000)
    assert manifest.count() == 0 and read_token_files(manifest).collect() == []


@pytest.mark.parametrize("entries", [3, 1 << 17])
def test_words_give_what_the_whole_text_gives(monkeypatch, entries):
    """Texts with every kind of white space beside blanks, through a cache that holds next to nothing too."""
    monkeypatch.setattr(words_cache, "MOST_ENTRIES", entries)
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as file:
        backend = _ByteLevel(file.read())
    assert backend.by_words
    spaces = ["\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", " ", "  "]
    texts = ["", " ", "a", " a", "a ", "a b", "a  b", "é ¿qué? – “x” ‥", "<|endoftext|> x <|endoftext|>", "x" * 3000 + " y" * 3000]
    texts += [f"word {s}next{s} one {s}" for s in spaces] + [f"{s} word" for s in spaces] + [f"a{s}b c" for s in spaces]
    docs = [r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()]
    for some in (texts, docs, texts, []):
        wanted = [[*e.ids, 0] for e in backend.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [i.tolist() for i in backend.encode(some, 0)] == wanted


def test_encoding_runs_without_the_cycle_search(monkeypatch):
    seen = []

    class Fake:
        def encode(self, texts, end_id):
            seen.append(gc.isenabled())
            return [np.array([end_id], np.uint32) for _ in texts]

    monkeypatch.setattr(token_files, "_byte_level", lambda definition: Fake())
    assert gc.isenabled()
    token_files.library_encoder("{}", 0)(pa.array(["a", None]))
    assert seen == [False] and gc.isenabled()


def test_released_caches_are_empty_and_fill_again():
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as file:
        backend = _ByteLevel(file.read())
    first = [i.tolist() for i in backend.encode(["a few plain words", "x  y"], 0)]
    assert backend.words.known
    words_cache.release_caches()
    assert not backend.words.known and not backend.words.older
    assert [i.tolist() for i in backend.encode(["a few plain words", "x  y"], 0)] == first
