"""SentencePiece models on the tokenizers library.

The model file is a protobuf message; it is read with a small field reader, and from it the library's normaliser, the
metaspace marker, the model (merges or unigram scores), byte fallback and the decoder are rebuilt. Batches are encoded
with the library's threads. Where asked, every text is also encoded by SentencePiece itself and compared.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memory import give_back
from tidemark.llm.text import buffers_of, slices
from tidemark.llm.words_cache import MODEL_LOADERS, WordCache, split_at_blanks

# Numbers of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARKER = "▁"
SLICE = 1 << 22  # bytes of text encoded at a time
MOST_COMPARED = 1 << 17  # ids of SentencePiece that are held as Python numbers at a time


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers of varints, bytes of all other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"unknown wire type {kind}: not a SentencePiece model")
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > len(message):
            raise ValueError("the model file ends inside a field")
        yield tag >> 3, message[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What the tokenizers library needs to know of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, message: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(message):
            if number == 1:
                parts = dict(_fields(value))
                score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
                model.pieces.append((parts.get(1, b"").decode(), score, parts.get(3, NORMAL)))
            elif number == 2:
                parts = dict(_fields(value))
                model.algorithm = parts.get(3, UNIGRAM)
                model.byte_fallback = bool(parts.get(35, 0))
                model.suffix_marker = bool(parts.get(24, 0))
            elif number == 3:
                parts = dict(_fields(value))
                model.char_map = parts.get(2, b"")
                model.dummy_prefix = bool(parts.get(3, 1))
                model.trim_spaces = bool(parts.get(4, 1))
                model.escape_spaces = bool(parts.get(5, 1))
        if not model.pieces:
            raise ValueError("the model file has no pieces")
        return model

    def breaks_at_markers(self) -> bool:
        """True if no piece goes on past a marker that follows another character: then words are independent."""
        return not any(MARKER in text.lstrip(MARKER) for text, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def build_backend(model: PieceModel):
    """A tokenizers `Tokenizer` that gives the ids of the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix_marker or not model.escape_spaces or any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("suffix markers, plain spaces and user-defined symbols are not supported")
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.algorithm == BPE:
        vocabulary = {text: number for number, (text, _, _) in enumerate(model.pieces)}
        usable = {text for text, _, kind in model.pieces if kind == NORMAL}
        ranked = sorted((p for p in enumerate(model.pieces) if p[1][2] == NORMAL), key=lambda p: (-p[1][1], p[0]))
        merges = [
            (text[:k], text[k:])
            for _, (text, _, _) in ranked
            for k in sorted(range(1, len(text)), key=lambda k: (vocabulary.get(text[:k], 0), vocabulary.get(text[k:], 0)))
            if text[:k] in usable and text[k:] in usable
        ]
        inner = models.BPE(
            vocabulary, merges, unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    elif model.algorithm == UNIGRAM:
        # Only normal pieces may match. A normalised text has no plain space, so a piece that starts with one never
        # does; byte pieces must keep their names for the fallback and get a score that loses against any spelling.
        least = min((score for _, score, kind in model.pieces if kind == NORMAL), default=0.0) - 10_000
        rows = [
            (text, least if kind == BYTE else score) if kind in (NORMAL, BYTE) else (f" {text}", score)
            for text, score, kind in model.pieces
        ]
        inner = models.Unigram(rows, unknown, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.algorithm} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(model.char_map)] if model.char_map else []
    if model.trim_spaces:
        steps += [normalizers.Replace(Regex(rf"\A +|[ {MARKER}]+\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    steps.append(normalizers.Replace(" ", MARKER))
    backend = Tokenizer(inner)
    backend.normalizer = normalizers.Sequence(steps)
    if model.breaks_at_markers():
        # Pieces never cross into the next word: words are cut first and met words come from the library's cache.
        backend.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    backend.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return backend


class _Pieces:
    """The backend, and the way to it word by word where the model's text is the plain text with markers for blanks."""

    def __init__(self, message: bytes):
        from tokenizers import normalizers

        model = PieceModel.parse(message)
        self.backend = build_backend(model)
        self.by_words = (
            model.breaks_at_markers() and model.dummy_prefix and not model.trim_spaces and not model.char_map
        )
        if self.by_words:
            self.plain = build_backend(model)
            self.plain.normalizer = normalizers.Sequence([])
            opens = np.array([text.startswith(MARKER) for text, _, _ in model.pieces])
            self.words = WordCache(self._plain_ids, MARKER, opens, self._come_back)

    def _plain_ids(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch_fast(parts, add_special_tokens=False)]

    def _come_back(self, parts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether parts, which all begin with a marker, are decoded as they were."""
        back = self.backend.decode_batch(ids, skip_special_tokens=False)
        return [text == part[1:].replace(MARKER, " ") for text, part in zip(back, parts, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as little-endian 32-bit numbers, and whether decoding them gives the text back.

        Where words are independent the decoder is asked once for each distinct word: a text comes back if all its words do and
        it has no marker of its own.
        """
        if not self.by_words:
            ids = [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.backend.decode_batch(ids, skip_special_tokens=False)
            return [np.array(i, "<u4").tobytes() for i in ids], [a == b for a, b in zip(back, texts, strict=True)]
        column = pa.array(texts, pa.large_string())
        data, offsets = buffers_of(column)
        plain = _plain_blanks(data, offsets)
        raw: list[bytes] = [b""] * len(texts)
        back = [True] * len(texts)
        if plain.any():
            places = np.flatnonzero(plain)
            words, parts = split_at_blanks(*buffers_of(column.filter(pa.array(plain))))
            flat, counts, lossy = self.words.of_words(words)
            ends = 4 * np.cumsum(counts)[np.cumsum(parts) - 1]
            whole, start = flat.tobytes(), 0
            for place, end in zip(places.tolist(), ends.tolist(), strict=True):
                raw[place] = whole[start:end]
                start = end
            for place in places[np.unique(np.repeat(np.arange(len(parts)), parts)[lossy])].tolist():
                back[place] = False
        odd = np.flatnonzero(~plain).tolist()
        parts = [_marked_parts(texts[k]) for k in odd]
        for k, own, ids in zip(odd, parts, self.words.raw(parts), strict=True):
            raw[k] = ids
            back[k] = MARKER not in texts[k] and self.words.lossy.isdisjoint(own)
        return raw, back


def _plain_blanks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that are not empty, have no blank at an end or beside another one, and no marker of their own."""
    plain = np.diff(offsets) > 0
    blanks = np.flatnonzero(data == 32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.append(data, np.uint8(32))[blanks + 1]
    bad = blanks[edge[blanks] | edge[blanks + 1] | (after == 32)]
    lead, second, third = np.frombuffer(MARKER.encode(), np.uint8)
    marks = np.flatnonzero(data[:-2] == lead) if len(data) > 2 else blanks[:0]
    marks = marks[(data[marks + 1] == second) & (data[marks + 2] == third)]
    plain[np.searchsorted(offsets, np.concatenate([bad, marks]), "right") - 1] = False
    return plain


def _marked_parts(text: str) -> list[str]:
    """Parts that a marker stands before, cut where another character comes before the marker."""
    if not text:
        return []
    parts = text.split(" ") if MARKER not in text else text.replace(MARKER, " ").split(" ")
    if "" not in parts:
        return parts
    merged, run = [], ""
    for part in parts:
        if part:
            merged.append(run + part)
            run = ""
        else:
            run += MARKER
    return [*merged, run[:-1]] if run else merged


@lru_cache(maxsize=2)
def _backend(model: bytes) -> _Pieces:
    return _Pieces(model)


@lru_cache(maxsize=2)
def _original(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


MODEL_LOADERS.extend([_backend, _original])


def read_model(path: str) -> bytes:
    """A model file of the driver. Its bytes (a vocabulary, bounded by design) travel with the tasks."""
    with open(path, "rb") as file:
        return file.read()


RESULT = "ids ARRAY<INT>, n_tokens BIGINT, ids_crc32 BIGINT, round_trip BOOLEAN, parity BOOLEAN"
_ARROW = pa.struct(
    [("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_())]
)


def _runs_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about MOST_COMPARED ids; a longer text is a range of its own."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(sizes):
        last = max(int(np.searchsorted(upto, upto[first] + MOST_COMPARED, "right")) - 1, first + 1)
        yield first, last
        first = last


def _encoded(texts: list[str], model: bytes, verify: bool) -> pa.Array:
    raw, back = _backend(model).encode(texts)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
    same: list[bool | None] = [None] * len(texts)
    if verify:
        same = []
        for first, last in _runs_of(sizes):
            theirs = _original(model).encode(texts[first:last], num_threads=1)
            counts = np.fromiter(map(len, theirs), np.int64, len(theirs))
            if np.array_equal(counts, sizes[first:last]):  # the normal case: all texts at once
                own = flat[starts[first] : starts[last]]
                differ = np.flatnonzero(np.fromiter(chain.from_iterable(theirs), np.int32, len(own)) != own)
                wrong = np.zeros(last - first, bool)
                wrong[np.searchsorted(starts[first : last + 1] - starts[first], differ, "right") - 1] = True
                same += (~wrong).tolist()
            else:
                same += [np.array(b, "<u4").tobytes() == a for a, b in zip(raw[first:last], theirs, strict=True)]
            del theirs
    arrays = [
        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat)), pa.array(sizes),
        pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(back, pa.bool_()), pa.array(same, pa.bool_()),
    ]
    return pa.StructArray.from_arrays(arrays, fields=list(_ARROW))


def with_pieces(
    docs: DataFrame, model: bytes, text: str = "text", out: str = "pieces", verify: bool = True, threads: int = 1
) -> DataFrame:
    """Add a struct with the ids of each whole text, their number and crc32, and whether decoding gives the text back.

    `parity` says whether SentencePiece gives the same ids (null without `verify`). A null or empty text has no ids. The
    crc is that of the ids as little-endian unsigned 32-bit integers. `threads` bounds the library's threads of one task.
    A model that rewrites text (case, width, spaces) has round_trip false where it did. Rows and other columns stay as
    they are, repeated rows alike; a column that has the name `out` is replaced; an empty table gives no rows.
    """

    def encode(column: pa.Array) -> pa.Array:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        parts = [_encoded(pc.fill_null(part, "").to_pylist(), model, verify) for part in slices(column, SLICE)]
        found = pa.concat_arrays(parts) if parts else _encoded([], model, False)
        del parts
        give_back()
        return found

    return docs.withColumn(out, F.arrow_udf(encode, RESULT)(F.col(text)))


def with_text(rows: DataFrame, model: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the decoded text of an id column; null ids give null, an empty list the empty text."""

    def decode(column: pa.Array) -> pa.Array:
        texts = _backend(model).backend.decode_batch([v or [] for v in column.to_pylist()], skip_special_tokens=False)
        return pa.array([t if v else None for t, v in zip(texts, column.is_valid().to_pylist(), strict=True)], pa.string())

    return rows.withColumn(out, F.arrow_udf(decode, "STRING")(F.col(ids)))
