"""Document fingerprints as threshold-scaled sketches of word shingles.

A text's shingles are its runs of five words (A-Z lower-cased; words are runs of bytes outside 0x20 and 0x09-0x0D; a
text with fewer words is one shingle). Each distinct shingle has a 64-bit hash, and the sketch holds every hash below
2^64 / SCALE, whatever the length of the text. So long and short texts are cut at the same place: sketches can be
merged by union, and the share of one text's hashes that another text has estimates its containment even when one of
them is a thousand times longer. A text that has fewer than LEAST hashes there keeps its LEAST smallest ones, all of them if it
has no more; its sketch says up to which hash it is complete, and two sketches are compared below the smaller of both marks.

A fingerprint is text: the 16 hexadecimal digits of that mark (exclusive; all f: nothing is missing), then 16 for each
hash in ascending order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import buffers_of, mix, slices, windows, words_of

WORDS = 5
SCALE = 8
LEAST = 16
COMPLETE = (1 << 64) - 1
BLOCK = 1 << 22  # characters of the texts that are compared at once
RANGES_PER_PARTITION = 4

_LENGTH_SEED = np.uint64(0xA24BAED4963EE407)


def _shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of a column, repeated ones included."""
    data, offsets = buffers_of(column)
    words = words_of(data, offsets, lower=True)
    first, hashes = windows(words, n)
    text = words.text[first]
    counts = np.bincount(words.text, minlength=len(column)) if len(words) else np.zeros(len(column), np.int64)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):  # the whole sequence is the only shingle
        at = np.concatenate([[0], np.cumsum(counts)])[:-1][few]
        whole = counts[few].astype(np.uint64) * _LENGTH_SEED
        for k in range(n - 1):
            more = counts[few] > k
            whole[more] = mix(whole[more] + words.hash[at[more] + k])
        text, hashes = np.concatenate([text, few]), np.concatenate([hashes, mix(whole)])
    return text, hashes


def sketches(column: pa.Array, words: int = WORDS, scale: int = SCALE, least: int = LEAST) -> list[tuple[int, np.ndarray]]:
    """The mark and the ascending hashes of every text of a column."""
    cut = np.uint64(COMPLETE // scale)
    found: list[tuple[int, np.ndarray]] = []
    for part in slices(column):
        text, hashes = _shingles(part, words)
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        text, hashes = text[new], hashes[new]
        bounds = np.searchsorted(text, np.arange(len(part) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = hashes[a:b]
            kept = max(int(np.searchsorted(own, cut)), min(least, len(own)))
            if kept == len(own):
                mark = COMPLETE
            else:
                mark = max(int(cut), int(own[kept]))
            found.append((mark, own[:kept]))
    return found


def to_text(sketch: tuple[int, np.ndarray]) -> str:
    mark, hashes = sketch
    return f"{mark:016x}" + hashes.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)
    return int(raw[0]), raw[1:]


def _below(hashes: np.ndarray, mark: int) -> np.ndarray:
    return hashes if mark == COMPLETE else hashes[: np.searchsorted(hashes, np.uint64(mark))]


def merge(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of both texts' shingles together."""
    mark = min(a[0], b[0])
    return mark, np.union1d(_below(a[1], mark), _below(b[1], mark))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated containment of the text with fewer shingles in the other one, 0 to 1.

    Equal sketches give 1, also those of two texts without words; a text without words is unlike any other. Where one
    sketch has no hash that can be compared, nothing speaks for a likeness and the result is 0.
    """
    mark = min(a[0], b[0])
    one, two = _below(a[1], mark), _below(b[1], mark)
    fewer = min(len(one), len(two))
    if not fewer:
        return 1.0 if a[0] == b[0] and np.array_equal(a[1], b[1]) else 0.0
    return len(np.intersect1d(one, two, assume_unique=True)) / fewer


def with_fingerprint(
    docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS, scale: int = SCALE, least: int = LEAST
) -> DataFrame:
    """Add the fingerprint of each text; all rows and other columns stay as they are.

    A null or empty text and one of white space has no hash and the mark ffffffffffffffff. Equal texts have equal
    fingerprints, so repeated rows do. Texts are read whole whatever their length. A column that has the name `out` is
    replaced; an empty table gives no rows.
    """

    def fingerprints(column: pa.Array) -> pa.Array:
        return pa.array([to_text(s) for s in sketches(column, words, scale, least)], pa.string())

    return docs.withColumn(out, F.arrow_udf(fingerprints, T.StringType())(F.col(f"`{text}`")))


def containment(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null where one of them is null."""

    def compared(one: pa.Array, two: pa.Array) -> pa.Array:
        pairs = zip(one.to_pylist(), two.to_pylist())
        return pa.array(
            [None if x is None or y is None else likeness(from_text(x), from_text(y)) for x, y in pairs], pa.float64()
        )

    return F.arrow_udf(compared, T.DoubleType())(a, b)


def merged_fingerprints(frame: DataFrame, by: str, fingerprint: str = "fingerprint", scale: int = 1 << 12) -> DataFrame:
    """One fingerprint per value of `by` (null is a value) for all its documents together, as columns `by` and `fingerprint`.

    Hashes are cut at 2^64 / `scale` first, so a merged sketch holds that share of a group's distinct shingles, however
    many documents and repeated rows it has; choose `scale` by the largest group. Null fingerprints count for nothing.
    """
    mark = f"{COMPLETE // scale:016x}"
    parts = frame.select(
        F.col(f"`{by}`").alias("by"),
        F.expr(f"transform(sequence(1, greatest(length(`{fingerprint}`) div 16, 1)), i -> substr(`{fingerprint}`, (i - 1) * 16 + 1, 16))").alias("p"),
    ).select("by", F.least(F.col("p")[0], F.lit(mark)).alias("mark"), F.expr(f"filter(slice(p, 2, size(p)), h -> h < '{mark}')").alias("p"))
    grouped = parts.groupBy("by").agg(
        F.coalesce(F.min("mark"), F.lit(f"{COMPLETE:016x}")).alias("mark")
    )
    hashes = parts.select("by", F.explode("p").alias("h")).distinct().groupBy("by").agg(F.collect_list("h").alias("h"))
    both = grouped.alias("g").join(hashes.alias("h"), F.expr("g.by <=> h.by"), "left")
    below = F.array_join(F.array_sort(F.filter(F.col("h.h"), lambda h: h < F.col("g.mark"))), "")
    return both.select(
        F.col("g.by").alias(by), F.concat(F.col("g.mark"), F.coalesce(below, F.lit(""))).alias("fingerprint")
    )


def _dealt(bounds: list, first_is_null: bool, schema: pa.Schema):
    """Give each row its range, and the rows that come first in a range also to the range before it."""
    at = pa.array(bounds, schema.field("id").type).to_numpy(zero_copy_only=False)
    last = max(len(at) - 1, 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            own = np.zeros(len(ids), np.int64)
            first = null & first_is_null
            if len(at):
                known = ids.filter(pa.array(~null)).to_numpy(zero_copy_only=False)
                place = np.searchsorted(at, known, "right") - 1
                own[~null] = place
                first[~null] = (at[place] == known) & ~((place == 0) & first_is_null)
            # The first range comes after the last one; where null ids come first, the smallest id follows them within its range.
            rows = np.flatnonzero(first)
            before = np.where(own[rows] > 0, own[rows] - 1, last)
            index = np.concatenate([np.arange(len(ids)), rows])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, before])),
                    pa.array(np.arange(len(index)) >= len(ids)),
                    ids.take(pa.array(index)),
                    batch.column("text").take(pa.array(index)),
                ],
                schema=schema,
            )

    return deal


class _Block:
    """Neighbouring texts whose edits and sketches are computed together."""

    def __init__(self, schema: pa.Schema, sketch: dict):
        self.schema, self.sketch = schema, sketch
        self.clear()

    def clear(self) -> None:
        self.texts: list[str] = []
        self.pairs: list[tuple[object, int, int]] = []
        self.size = 0

    def add(self, text: str) -> int:
        self.texts.append(text)
        self.size += len(text)
        return len(self.texts) - 1

    def result(self) -> pa.RecordBatch:
        halves = [len(self.texts[a]) // 2 for _, a, _ in self.pairs]
        edited = [
            self.texts[a][: len(self.texts[a]) - half] + self.texts[b][:half] for half, (_, a, b) in zip(halves, self.pairs)
        ]
        own = sketches(pa.array(self.texts, pa.large_string()), **self.sketch)
        changed = sketches(pa.array(edited, pa.large_string()), **self.sketch)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key for key, _, _ in self.pairs], self.schema.field(0).type),
                pa.array([len(self.texts[a]) for _, a, _ in self.pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([to_text(own[a]) for _, a, _ in self.pairs], pa.string()),
                pa.array([to_text(c) for c in changed], pa.string()),
                pa.array([likeness(own[a], c) for (_, a, _), c in zip(self.pairs, changed)], pa.float64()),
                pa.array([likeness(own[a], own[b]) for _, a, b in self.pairs], pa.float64()),
            ],
            schema=self.schema,
        )


def compare_with_next(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, scale: int = SCALE, least: int = LEAST
) -> DataFrame:
    """Fingerprints of each text and of the same text with its last half replaced by the begin of the next document.

    Documents follow each other by ascending `id` (integers or text; nulls first), rows of one id by text; the first one follows
    the last. Of a text of n code points the last n // 2 are replaced by the first n // 2 of the next document, or by
    all it has. A null text is empty; a single row is its own next one. Repeated rows stay rows of their own: each is
    followed by its copy, the last copy by the next text. Other columns are not read, so their names do not matter.

    The texts cross one shuffle, dealt by ranges of ids whose bounds come from the ids alone; the first row of a range goes
    to the range before it as well. The driver holds one id per range, RANGES_PER_PARTITION for each shuffle partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (
        rows.select("id")
        .repartitionByRange(ranges, "id")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("null"))
        .collect()
    )
    bounds = sorted(r.first for r in found if r.first is not None)
    id_type = rows.schema["id"].dataType
    result = T.StructType(
        [
            T.StructField(id, id_type),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    arrow_id = pa.string() if isinstance(id_type, T.StringType) else pa.int64() if isinstance(id_type, T.LongType) else pa.int32()
    dealt_schema = pa.schema([("range", pa.int64()), ("border", pa.bool_()), ("id", arrow_id), ("text", pa.string())])
    result_schema = pa.schema(
        [(id, arrow_id), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    sketch = {"words": words, "scale": scale, "least": least}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(result_schema, sketch)
        before = None  # id and place in the block of the row before, unless that was a border
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("border", "id", "text"))
            for border, key, content in zip(*columns):
                place = block.add(content)
                if before is not None:
                    block.pairs.append((before[0], before[1], place))
                if block.size >= BLOCK and block.pairs:
                    yield block.result()
                    block.clear()
                    place = block.add(content)
                before = None if border else (key, place)
        if block.pairs:
            yield block.result()

    dealt = rows.mapInArrow(
        _dealt(bounds, any(r.null for r in found), dealt_schema),
        T.StructType(
            [
                T.StructField("range", T.LongType()),
                T.StructField("border", T.BooleanType()),
                T.StructField("id", id_type),
                T.StructField("text", T.StringType()),
            ]
        ),
    )
    in_order = dealt.repartition("range").sortWithinPartitions("range", "border", "id", "text")
    return in_order.mapInArrow(compare, result)
