"""Token ids as raw binary shards with a minimal perfect hash index from document keys to offsets.

`ids-N.bin` holds the ids of shard N one after the other, little-endian, in ascending key order; `ids-N.idx` holds an
Arrow table and three arrays: per row its key and first id, per key (at its perfect-hash number) a fingerprint and its
first row, and the hash itself. Shards are ranges of keys in ascending order, so a key is found by its shard, one hash,
one fingerprint and one range read, whatever the number of documents.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.files import new_file, open_ranges
from tidemark.llm.perfect_hash import PerfectHash, fingerprints
from tidemark.llm.text import buffers_of, slices
from tidemark.llm.words_cache import MODEL_LOADERS, WordCache, cut_at_every_blank, parts_before_words, split_at_blanks

MAGIC = b"TMIDX001"
READ_IDS = 1 << 20
MANIFEST = "shard INT, path STRING, width INT, n_docs BIGINT, n_ids BIGINT, first_key BIGINT, last_key BIGINT"


class _ByteLevel:
    """A byte-level tokenizer of the tokenizers library whose pre-tokens never hold a blank before a word.

    Its cutting pattern starts a new pre-token at a blank that a word, number or sign follows, and its special tokens
    hold no blank; so a text may be cut there first, and each distinct part is encoded once.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        plan = json.loads(definition)
        cut = plan.get("pre_tokenizer") or {}
        special = [t["content"] for t in plan.get("added_tokens", [])]
        self.by_words = (
            cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space")
            and cut.get("use_regex", True)
            and plan.get("normalizer") is None
            and not any(" " in s for s in special)
            and not any(t.get("lstrip") or t.get("rstrip") for t in plan.get("added_tokens", []))
        )
        self.words = WordCache(self._all, " ", self._opens()) if self.by_words else None

    def _opens(self) -> np.ndarray:
        """Ids whose bytes begin with a blank; byte-level vocabularies write the blank as U+0120."""
        opens = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        opens[[number for token, number in self.tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True
        return opens

    def _all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array([*ids, end_id], np.uint32) for ids in self._all(texts)]
        end = struct.pack("<I", end_id)
        column = pa.array(texts, pa.large_string())
        plain = cut_at_every_blank(*buffers_of(column), texts)
        heads: list[str] = [""] * len(texts)
        rest: list[bytes] = [b""] * len(texts)
        if plain.any():
            places = np.flatnonzero(plain)
            words, parts = split_at_blanks(*buffers_of(column.filter(pa.array(plain))))
            firsts = np.cumsum(parts) - parts
            later = np.ones(len(words), bool)
            later[firsts] = False
            flat, counts, _ = self.words.of_words(words.filter(pa.array(later)))
            upto = np.concatenate([[0], np.cumsum(counts)])
            ends = 4 * upto[np.cumsum(parts - 1)]
            whole, start = flat.tobytes(), 0
            for place, head, stop in zip(places.tolist(), words.take(pa.array(firsts)).to_pylist(), ends.tolist(), strict=True):
                heads[place], rest[place] = head, whole[start:stop]
                start = stop
        odd = np.flatnonzero(~plain).tolist()
        parts = [parts_before_words(texts[k]) for k in odd]
        for k, own, ids in zip(odd, parts, self.words.raw([p[1:] for p in parts]), strict=True):
            heads[k], rest[k] = own[0], ids
        first = self._all(heads)
        return [np.frombuffer(b"".join((np.array(head, "<u4").tobytes(), ids, end)), "<u4") for head, ids in zip(first, rest, strict=True)]


@lru_cache(maxsize=2)
def _byte_level(definition: str) -> _ByteLevel:
    return _ByteLevel(definition)


MODEL_LOADERS.append(_byte_level)


def library_encoder(definition: str, end_id: int, threads: int = 1) -> Callable[[pa.Array], list[np.ndarray]]:
    """Encode a text column with the tokenizers library; `definition` is the tokenizer's JSON. Null counts as empty."""

    def encode(column: pa.Array) -> list[np.ndarray]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        # Ids and words come as very many small objects without cycles; looking for cycles among them took a tenth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return _byte_level(definition).encode(pc.fill_null(column, "").to_pylist(), end_id)
        finally:
            if collecting:
                gc.enable()

    return encode


def _write_index(uri: str, keys: np.ndarray, known: np.ndarray, starts: np.ndarray) -> None:
    """`known` marks rows whose key is not null; null keys cannot be asked for but are kept in row order."""
    distinct, first_row = np.unique(keys[known], return_index=True)
    first_row = np.flatnonzero(known)[first_row]
    hashed = PerfectHash.build(distinct)
    slot = hashed.number(distinct)
    prints, rows = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8")
    prints[slot], rows[slot] = fingerprints(distinct), first_row
    parts = [keys.astype("<i8"), known.astype("u1"), starts.astype("<i8"), hashed.sizes.astype("<i8"),
             hashed.words.astype("<u8"), hashed.before.astype("<i8"), prints, rows]
    with new_file(uri) as out:
        out.write(MAGIC + struct.pack(f"<{len(parts)}q", *[p.nbytes for p in parts]))
        for part in parts:
            out.write(part.tobytes())


class ShardIndex:
    """The index of one shard; ids are read by range from its data file."""

    def __init__(self, path: str, width: int):
        self.path, self.dtype = path, f"<u{width}"
        with open_ranges(f"{path}.idx") as file:
            head = file.read_at(len(MAGIC) + 64, 0)
            if head[: len(MAGIC)] != MAGIC:
                raise ValueError(f"{path}.idx is no token index")
            sizes = struct.unpack("<8q", head[len(MAGIC) :])
            at, parts = len(head), []
            for size, kind in zip(sizes, ("<i8", "u1", "<i8", "<i8", "<u8", "<i8", "<u4", "<i8"), strict=True):
                parts.append(np.frombuffer(file.read_at(size, at), kind))
                at += size
        self.keys, known, self.starts, levels, words, before, self.prints, self.rows = parts
        self.known = known.astype(bool)
        self.hash = PerfectHash(levels, words, before)

    def first_rows(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, -1 for a key that is not here. Rows of one key follow each other."""
        keys = np.ascontiguousarray(keys, np.int64)
        slot = self.hash.number(keys)
        slot[slot >= 0] = np.where(self.prints[slot[slot >= 0]] == fingerprints(keys[slot >= 0]), slot[slot >= 0], -1)
        return np.where(slot >= 0, self.rows[slot] if len(self.rows) else -1, -1)

    def ids(self, file, first_row: int, end_row: int) -> np.ndarray:
        a, b = int(self.starts[first_row]), int(self.starts[end_row])
        size = np.dtype(self.dtype).itemsize
        return np.frombuffer(file.read_at((b - a) * size, a * size), self.dtype)


def write_token_files(
    docs: DataFrame, folder: str, encode: Callable[[pa.Array], list[np.ndarray]], largest_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the ids of every row in ascending `doc_id` order (null last) and return the manifest, one row per shard.

    Rows of one id are ordered by a hash of their text and all kept. Every row has at least the end id, so a null or
    empty text has one. Ids take two bytes where `largest_id` allows it. An empty table gives an empty manifest. Rows
    travel once, to their range; a shard's ids are streamed to its file, only keys and offsets stay in memory.
    """
    width = 2 if largest_id < 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path = f"{folder}/ids-{shard:06d}"
        keys, known, sizes = [], [], []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with new_file(f"{path}.bin") as out:
            for batch in _chain(first, batches):
                column = batch.column(1)
                for part in slices(column, 1 << 22):
                    ids = encode(part)
                    out.write(np.concatenate(ids).astype(f"<u{width}").tobytes())
                    sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                keys.append(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                known.append(pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False))
        key, there = np.concatenate(keys), np.concatenate(known)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        _write_index(f"{path}.idx", key, there, starts)
        ends = [int(key[there][k]) if there.any() else None for k in (0, -1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([path]), pa.array([width], pa.int32()), pa.array([len(key)]),
             pa.array([int(starts[-1])]), pa.array([ends[0]], pa.int64()), pa.array([ends[1]], pa.int64())],
            names=["shard", "path", "width", "n_docs", "n_ids", "first_key", "last_key"],
        )

    order = [F.col("__key").asc_nulls_last(), F.xxhash64("__text").asc()]
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("__key"), F.col(text).alias("__text"))
    manifest = f"{folder}/manifest"
    narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every stored row, found by its key: doc_id, start (ids of all rows before it), n_tokens, ids_crc32 and ids.

    The crc is that of the ids as little-endian unsigned 32-bit integers.
    """
    spark = manifest.sparkSession
    shards = max(1, manifest.count())
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            index = ShardIndex(row["path"], row["width"])
            rows = np.arange(len(index.keys))
            found = index.first_rows(index.keys)
            # The key leads to its first row; a repeated key's rows follow it. Null keys have no entry.
            same = np.concatenate([[False], (index.keys[1:] == index.keys[:-1]) & index.known[1:] & index.known[:-1]])
            at = np.where(index.known, found + rows - np.maximum.accumulate(np.where(same, 0, rows)), rows)
            if (at != rows).any():
                raise ValueError(f"{row['path']}: keys lead to wrong rows")
            with open_ranges(f"{row['path']}.bin") as file:
                for a, b in _row_ranges(index.starts):
                    ids = index.ids(file, a, b).astype("<u4")
                    starts = index.starts[a : b + 1] - index.starts[a]
                    crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index.keys[a:b], mask=~index.known[a:b]), pa.array(index.starts[a:b] + row["before"]),
                         pa.array(np.diff(starts)), pa.array(crc, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view("<i4")))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return (
        placed.repartitionByRange(shards, "shard")
        .mapInArrow(read, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, ids ARRAY<INT>")
    )


def _row_ranges(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(starts) - 1:
        b = int(np.searchsorted(starts, starts[a] + READ_IDS, "right")) - 1
        b = min(max(b, a + 1), len(starts) - 1)
        yield a, b
        a = b


def look_up(spark: SparkSession, manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the asked keys: (key, ids), one row per stored row of each distinct key; unknown and null keys give none.

    Each key goes to the shards whose range holds it (a shard boundary can divide a key's rows), there it costs one
    hash, one fingerprint and one range read.
    """
    ranges = manifest.filter(F.col("first_key").isNotNull())
    asked = keys.select(F.col(key).cast("bigint").alias("key")).filter(F.col("key").isNotNull()).distinct()
    routed = asked.join(ranges, F.col("key").between(F.col("first_key"), F.col("last_key")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: ShardIndex | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held.path != row["path"]:
                    held = ShardIndex(row["path"], row["width"])
                first = int(held.first_rows(np.array([row["key"]]))[0])
                if first < 0:
                    continue
                end = first + 1
                while end < len(held.keys) and held.keys[end] == row["key"] and held.known[end]:
                    end += 1
                with open_ranges(f"{held.path}.bin") as file:
                    ids = [held.ids(file, r, r + 1).astype(np.int32) for r in range(first, end) if held.keys[r] == row["key"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]] * len(ids), pa.int64()), pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))],
                    names=["key", "ids"],
                )

    return (
        routed.repartition("path").sortWithinPartitions("path", "key")
        .select("key", "path", "width").mapInArrow(read, "key BIGINT, ids ARRAY<INT>")
    )
