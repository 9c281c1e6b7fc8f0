"""N-gram Jaccard join by universe partitioning and pigeonhole.

Texts are sets of word shingles. Two sets at least `percent` similar differ in at most H elements, and H follows from a
band of sizes. Hashing the universe into H + 1 segments, at least one segment must be equal in both: every set indexes
the hash of each of its segments. Where a plain segment cannot tell, one-deletion neighbourhoods can (a segment counts
double if its sets minus any one element are indexed as well), and they are allocated where they pay:

* a segment that is empty in both sets proves nothing and is not indexed; a set with empty segments indexes the
  neighbourhoods of as many of its first segments instead, which restores the guarantee;
* comparing the members of a key costs the square of their number, indexing them again costs their number times the size of a
  neighbourhood. A key for which the second is less (many sets that share a passage) is given up, and its sets are
  indexed again with half the segments, all with neighbourhoods: those larger segments seldom hold nothing but a passage.

Sets that meet are compared by parity sketches first: each element flips one of m bits, so two sketches differ in at most as many
bits as the sets have different elements, and more differing bits than a link allows rule it out without a text. Only
pairs that pass are verified on the whole sets. No group is expanded into pairs: its members are compared with its first
one, and what that leaves in different components is compared by sketches inside one task, which gives each member's nearest
partner, then what is still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.columns import unused
from tidemark.llm.components import components
from tidemark.llm.text import buffers_of, mix, slices, windows, words_of
from tidemark.llm.words_cache import frugal
from tidemark.session import work_dir

WORDS = 4
PERCENT = 85
SPREAD = 512
COMPARISONS_PER_ENTRY = 32  # sketch comparisons that cost about as much as one index entry
MOST_HELD = 1 << 25  # bytes of the sketches of one block of a group
MOST_PAIRS = 1 << 18  # pairs of a group that a task holds before it hands them on
SLICE = 1 << 19  # bytes of text whose index entries are made at a time
LEAST_BITS, MOST_BITS = 256, 1 << 15
LARGEST_SET = 1 << 40

_ELEMENT = np.uint64(0x8CB92BA72F3D8DD7)


# Sets ---------------------------------------------------------------------------------------------


@dataclass
class Sets:
    """Distinct shingle hashes of many texts, sorted by text, and the size of each set."""

    text: np.ndarray
    hash: np.ndarray
    size: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])


def sets_of(column: pa.Array, n: int) -> Sets:
    """Shingles of `n` lower-case words; a text with fewer words has the whole sequence as its one shingle."""
    data, offsets = buffers_of(column)
    words = words_of(data, offsets, lower=True)
    count = np.bincount(words.text, minlength=len(column))
    first, hashes = windows(words, n)
    text = [words.text[first]]
    found = [hashes]
    for few in range(1, n):
        first, hashes = windows(words, few)
        short = count[words.text[first]] == few
        text.append(words.text[first][short])
        found.append(mix(hashes[short] + np.uint64(few)))
    text, found = np.concatenate(text), np.concatenate(found)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    text, found = text[new], found[new]
    return Sets(text, found, np.bincount(text, minlength=len(column)))


def class_ids(sets: Sets) -> np.ndarray:
    """A 64-bit hash of each whole set; equal sets are one class."""
    sums = _sums(mix(sets.hash ^ _ELEMENT), sets.starts)
    return mix(sums + sets.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=upto[1:])
    return upto[starts[1:]] - upto[starts[:-1]]


# Bands and allocation -----------------------------------------------------------------------------


@lru_cache(maxsize=8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower size of each band, and the largest difference H in its space.

    Linked sets lie in one band or in neighbouring ones; space k has the pairs whose smaller set is in band k.
    """
    lower, most = [1], []
    while lower[-1] < LARGEST_SET:
        lower.append(max(lower[-1] + 1, (lower[-1] - 1) * 100 // percent + 1))
        small = lower[-1] - 1
        most.append((100 - percent) * (small + small * 100 // percent) // (100 + percent))
    return np.array(lower, np.int64), np.array(most, np.int64)


def _keys(sums: np.ndarray, space: np.ndarray, segment: np.ndarray) -> np.ndarray:
    place = mix(space.astype(np.uint64) * np.uint64(1_000_003) + segment.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return mix(sums + place).view(np.int64)


def index_keys(sets: Sets, owner: np.ndarray, space: np.ndarray, percent: int, crowded: bool) -> tuple[np.ndarray, np.ndarray]:
    """(entry number, key) of all index entries; entry e is set owner[e] in space[e].

    Plain: a key per filled segment, H + 1 segments. Crowded: half as many, each with its whole neighbourhood.
    """
    _, most = bands(percent)
    difference = most[space]
    segments = (difference + 2) // 2 if crowded else difference + 1
    starts, sizes = sets.starts, sets.size[owner]
    at = np.concatenate([[0], np.cumsum(sizes)])
    entry = np.repeat(np.arange(len(owner)), sizes)
    element = np.arange(at[-1]) - at[entry] + starts[owner[entry]]
    hashes = sets.hash[element]
    seed = np.uint64(0xD6E8FEB86659FD93 if crowded else 0xA3B195354A39B70D)
    segment = (mix(hashes + seed) % segments[entry].astype(np.uint64)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(segments)])
    group = base[entry] + segment
    order = np.argsort(group, kind="stable")
    group, values = group[order], mix(hashes[order] ^ _ELEMENT)
    filled = np.bincount(group, minlength=base[-1])
    sums = _sums(values, np.concatenate([[0], np.cumsum(filled)]))
    of_group = np.repeat(np.arange(len(owner)), segments)
    number = np.arange(base[-1]) - base[of_group]

    if crowded:
        shown = np.ones(base[-1], bool)
        with_neighbours = np.full(len(owner), LARGEST_SET)
        least = 1
    else:
        shown = filled > 0
        empty = segments - np.bincount(of_group[shown], minlength=len(owner))
        with_neighbours = np.zeros(len(owner), np.int64)
        for e in np.flatnonzero(empty):
            enough = np.cumsum(filled[base[e] : base[e + 1]] >= 2)
            if enough[-1] >= empty[e]:
                with_neighbours[e] = np.searchsorted(enough, empty[e]) + 1
            else:  # too few segments to make up for it; two such sets meet in what is empty in both
                with_neighbours[e] = segments[e]
                shown[base[e] : base[e + 1]] = True
        least = 2
    keys = _keys(sums, space[of_group], number)
    chosen = np.flatnonzero(shown)
    in_order = of_group[group]
    near = np.flatnonzero((number[group] < with_neighbours[in_order]) & (filled[group] >= least))
    less = _keys(sums[group[near]] - values[near], space[in_order[near]], number[group[near]])
    return np.concatenate([of_group[chosen], in_order[near]]), np.concatenate([keys[chosen], less])


def spaces_of(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, space): each filled set is in the space of its own band and of the band below."""
    lower, _ = bands(percent)
    band = np.searchsorted(lower, size, "right") - 1
    filled = np.flatnonzero(size > 0)
    below = filled[band[filled] > 0]
    return np.concatenate([filled, below]), np.concatenate([band[filled], band[below] - 1])


def sketch_bits(space: np.ndarray, percent: int) -> np.ndarray:
    """Bits of a sketch in each space: a power of two about the size of its sets."""
    lower, _ = bands(percent)
    size = lower[np.minimum(space + 1, len(lower) - 1)] * 100 // percent
    return 1 << np.ceil(np.log2(np.clip(size, LEAST_BITS, MOST_BITS))).astype(np.int64)


def parity_sketches(sets: Sets, owner: np.ndarray, space: np.ndarray, percent: int) -> list[bytes]:
    """The sketch of set owner[e] in space[e]."""
    spread, starts = mix(sets.hash ^ np.uint64(0x5851F42D4C957F2D)), sets.starts
    found = []
    for own, bits in zip(owner.tolist(), sketch_bits(space, percent).tolist()):
        places = (spread[starts[own] : starts[own + 1]] & np.uint64(bits - 1)).astype(np.int64)
        found.append(np.packbits(np.bincount(places, minlength=bits) & 1).tobytes())
    return found


def may_link(differing: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b can link whose sketches differ in so many bits."""
    sizes = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    return sizes & (differing.astype(np.int64) * (100 + percent) <= (100 - percent) * (a + b))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets of distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


# Spark --------------------------------------------------------------------------------------------


def _written(frame: DataFrame, purpose: str, schema: str) -> DataFrame:
    spark = frame.sparkSession
    path = work_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


MEMBER = "doc_id BIGINT, text_hash BIGINT, n_shingles BIGINT, cid BIGINT"


def members(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """The class of every row: doc_id, a hash of its text, n_shingles and cid (null for an empty set)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(2), SLICE):
                sets = sets_of(part, words)
                cid = pa.array(class_ids(sets), mask=sets.size == 0)
                ids, hashes = (batch.column(k).slice(at, len(part)) for k in (0, 1))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [ids, hashes, pa.array(sets.size.astype(np.int64)), cid], names=["doc_id", "text_hash", "n_shingles", "cid"]
                )

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return _written(given.mapInArrow(frugal(place), MEMBER), "jaccard-members", MEMBER)


def _meetings(entries: DataFrame) -> DataFrame:
    """Of index entries (key, space, cid), those of keys that several classes share, with the least class as `pivot`.

    The entries of a key are read as one sorted stream; nothing of a group is held but its first class.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot_key = pivot = pivot_space = last = None
        alone = True  # the pivot has not been written yet
        for batch in batches:
            key, space, cid = (batch.column(k).to_numpy() for k in range(3))
            if not len(key):
                continue
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), bool)
            again[1:] = ~new_key[1:] & (cid[1:] == cid[:-1])
            if pivot_key is not None and key[0] == pivot_key:
                new_key[0] = False
                again[0] = cid[0] == last
            first = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), -1))
            pivots = np.where(first >= 0, cid[np.maximum(first, 0)], pivot if pivot is not None else 0)
            joins = ~new_key & ~again
            heads = np.unique(first[joins])
            out = [key[joins], space[joins], cid[joins], pivots[joins]]
            opened = heads[heads >= 0]
            if len(heads) and heads[0] < 0 and alone:
                extra = [[pivot_key], [pivot_space], [pivot], [pivot]]
                out = [np.concatenate([np.array(e), o]) for e, o in zip(extra, out, strict=True)]
            out = [np.concatenate([o, v[opened]]) for o, v in zip(out, (key, space, cid, cid), strict=True)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                    names=["key", "space", "cid", "pivot"],
                )
            tail = int(first[-1])
            if tail >= 0:
                alone = not (len(opened) and opened[-1] == tail)
                pivot_key, pivot, pivot_space = int(key[tail]), int(cid[tail]), int(space[tail])
            elif len(heads):
                alone = False
            last = int(cid[-1])

    ordered = entries.repartition("key").sortWithinPartitions("key", "cid")
    return _written(ordered.mapInArrow(frugal(meet), GROUP), "jaccard-groups", GROUP)


GROUP = "key BIGINT, space INT, cid BIGINT, pivot BIGINT"
ENTRY = "key BIGINT, space INT, cid BIGINT"


def _entries(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Plain index entries of all texts; a class that a task has met before is not indexed again by it."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                sets = sets_of(part, words)
                cid = class_ids(sets)
                owner, space = spaces_of(np.where(_first_met(cid, met), sets.size, 0), percent)
                yield _entry_batch(sets, owner, space, cid, percent, False)

    return docs.select(F.col(text)).mapInArrow(frugal(index), ENTRY)


def _first_met(cid: np.ndarray, met: set[int]) -> np.ndarray:
    first = np.zeros(len(cid), bool)
    for k, c in enumerate(cid.tolist()):
        if c not in met:
            met.add(c)
            first[k] = True
    return first


def _entry_batch(sets: Sets, owner: np.ndarray, space: np.ndarray, cid: np.ndarray, percent: int, crowded: bool) -> pa.RecordBatch:
    entry, key = index_keys(sets, owner, space, percent, crowded)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(space[entry].astype(np.int32)), pa.array(cid[owner[entry]])], names=["key", "space", "cid"]
    )


def _crowded_entries(asked: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Neighbourhood entries of (cid, space) pairs."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(2), 1 << 18):
                sets = sets_of(part, words)
                cid, space = (batch.column(k).slice(at, len(part)).to_numpy() for k in (0, 1))
                at += len(part)
                yield _entry_batch(sets, np.arange(len(part)), space.astype(np.int64), cid, percent, True)

    return asked.join(texts, "cid").select("cid", "space", "text").mapInArrow(frugal(index), ENTRY)


EDGE = "a BIGINT, b BIGINT, linked BOOLEAN"


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Test each pair (a, b) of distinct classes. The text of `a` travels once per SPREAD of its pairs, that of `b` with
    each pair; one pair after the other streams past the set of `a`."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SPREAD)).cast("int").alias("salts"))
    salted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    own = (
        counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .join(texts.withColumnRenamed("cid", "a"), "a")
        .select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")
    )
    others = salted.join(texts.withColumnRenamed("cid", "b"), "b").select("a", "salt", "b", "text")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            at = 0
            for part in slices(batch.column(3), SLICE):
                sets = sets_of(part, words)
                starts = sets.starts
                a, b, linked = [], [], []
                rows = zip(batch.column(0).slice(at, len(part)).to_pylist(), batch.column(2).slice(at, len(part)).to_pylist(), strict=True)
                at += len(part)
                for k, (left, right) in enumerate(rows):
                    mine = sets.hash[starts[k] : starts[k + 1]]
                    if right is None:
                        current, held = left, mine.copy()
                        continue
                    if left != current:
                        raise ValueError("a pair came before its first text")
                    a.append(left)
                    b.append(right)
                    linked.append(similar(held, mine, percent))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    stream = own.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return _written(stream.mapInArrow(frugal(test), EDGE), "jaccard-tested", EDGE)


SKETCH = "cid BIGINT, space INT, n BIGINT, sketch BINARY"


def _sketches(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Sketches of (cid, text) rows in the spaces of each set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), SLICE):
                sets = sets_of(part, words)
                cid = batch.column(0).slice(at, len(part)).to_numpy()
                at += len(part)
                owner, space = spaces_of(sets.size, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[owner]), pa.array(space.astype(np.int32)), pa.array(sets.size[owner].astype(np.int64)),
                     pa.array(parity_sketches(sets, owner, space, percent), pa.binary())],
                    names=["cid", "space", "n", "sketch"],
                )

    return _written(texts.select("cid", "text").mapInArrow(frugal(sketch), SKETCH), "jaccard-sketches", SKETCH)


PAIR = "a BIGINT, b BIGINT"


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _rows_of(column: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    # Taken as windows: an index of every byte would be eight times as large as the sketches.
    return np.lib.stride_tricks.sliding_window_view(data, length)[offsets[rows]]


def _with_first(sketched: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each group's first member with the others that may link; rows are (key, cid, n, sketch)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the first member of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, cid, n = (batch.column(k).to_numpy() for k in range(3))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            lengths = pc.binary_length(batch.column(3)).to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero((lengths == length) & ~new)
                for part in np.array_split(rows, len(rows) * length // MOST_HELD + 1):
                    heads = first[part]
                    differing = np.bitwise_count(_rows_of(batch.column(3), part, length) ^ _rows_of(batch.column(3), heads, length)).sum(1, np.int64)
                    good = may_link(differing, n[part], n[heads], percent)
                    yield _pair_batch(cid[heads[good]], cid[part[good]])
            held = batch.slice(int(first[-1]), 1)

    ordered = sketched.select("key", "cid", "n", "sketch").repartition("key").sortWithinPartitions("key", "cid")
    return ordered.mapInArrow(frugal(compare), PAIR).distinct()


def _across(sketched: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of members of one group in different components that may link: each member's nearest, or all.

    Rows are (key, lo, hi, block, cid, label, n, sketch): a group of several blocks comes as one group per pair of blocks,
    so a task holds at most two blocks.
    """

    def pairs(rows: tuple[np.ndarray, ...], sketch: np.ndarray, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        block, cid, label, n = rows
        best, partner = np.full(len(cid), np.iinfo(np.int64).max), np.full(len(cid), -1)
        one, two, waiting = [], [], 0
        for k in range(len(cid) - 1):
            differing = np.bitwise_count(sketch[k] ^ sketch[k + 1 :]).sum(1, np.int64)
            good = may_link(differing, n[k], n[k + 1 :], percent) & (label[k + 1 :] != label[k])
            if lo != hi:
                good &= block[k + 1 :] != block[k]
            others = np.flatnonzero(good) + k + 1
            if not len(others):
                continue
            if not nearest:
                one.append(np.full(len(others), cid[k]))
                two.append(cid[others])
                waiting += len(others)
                if waiting >= MOST_PAIRS:
                    yield _pair_batch(np.concatenate(one), np.concatenate(two))
                    one, two, waiting = [], [], 0
                continue
            near = differing[others - k - 1]
            if near.min() < best[k]:
                best[k], partner[k] = near.min(), others[near.argmin()]
            closer = near < best[others]
            best[others[closer]], partner[others[closer]] = near[closer], k
        if nearest:
            rows_with = np.flatnonzero(partner >= 0)
            one, two = [cid[rows_with]], [cid[partner[rows_with]]]
        if one:
            yield _pair_batch(np.concatenate(one), np.concatenate(two))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                block, cid, label, n = (whole.column(k).to_numpy() for k in range(3, 7))
                length = len(whole.column(7)[0].as_py())
                sketch = _rows_of(whole.column(7), np.arange(len(cid)), length)
                yield from pairs((block, cid, label, n), sketch, group[1], group[2])

        for batch in batches:
            ids = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1 if len(ids) else []
            bounds = [0, *cuts, len(ids)] if len(ids) else [0]
            for begin, end in zip(bounds[:-1], bounds[1:]):
                now = tuple(ids[begin].tolist())
                if now != group:
                    yield from done()
                    held, group = [], now
                held.append(batch.slice(begin, end - begin))
        yield from done()

    columns = ["key", "lo", "hi", "block", "cid", "label", "n", "sketch"]
    ordered = sketched.select(*columns).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid")
    return ordered.mapInArrow(frugal(compare), PAIR).distinct()


LABEL = "node BIGINT, component BIGINT"


class _Search:
    """The tested pairs so far and the components they make."""

    def __init__(self, spark: SparkSession, texts: DataFrame, words: int, percent: int):
        self.texts, self.words, self.percent = texts, words, percent
        self.sketches = _sketches(texts, words, percent)
        # From Arrow tables, since Python rows would start workers of another kind beside those of the tasks.
        self.tested = spark.createDataFrame(pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())]).empty_table())
        self.labels = spark.createDataFrame(pa.schema([("node", pa.int64()), ("component", pa.int64())]).empty_table())

    def test(self, pairs: DataFrame) -> bool:
        """Verify the pairs that are new; true if there were any."""
        new = _written(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"), "jaccard-pairs", PAIR)
        if new.isEmpty():
            return False
        found = _verified(new, self.texts, self.words, self.percent)
        self.tested = self.tested.unionByName(found)
        # Only what the new links connect is worked on: edges between components as they were.
        between = self._between(found.filter("linked")).select("la", "lb")
        merged = components(between, "la", "lb")
        renamed = self.labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
        self.labels = _written(
            renamed.select("node", F.coalesce("now", "component").alias("component")).unionByName(
                merged.join(self.labels.select("node"), "node", "left_anti")
            ),
            "jaccard-labels",
            LABEL,
        )
        return True

    def _between(self, pairs: DataFrame) -> DataFrame:
        """Pairs with the components of both classes, as far as these differ."""
        of_a, of_b = (self.labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b"))
        named = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
        return named.select("a", "b", F.coalesce("ca", "a").alias("la"), F.coalesce("cb", "b").alias("lb")).filter("la != lb")

    def first_members(self, groups: DataFrame) -> None:
        """Compare the members of all groups with their first ones: one partner of each member before the others."""
        sketched = groups.select("key", "space", "cid").join(self.sketches, ["cid", "space"])
        pairs = _written(_with_first(sketched, self.percent), "jaccard-first", PAIR)
        for _ in range(2):
            # Most keys of a class lead to one component; what the first one has settled needs no test.
            if not self.test(self._between(pairs).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")):
                return
        self.test(self._between(pairs).select("a", "b"))

    def unsettled(self, groups: DataFrame) -> DataFrame:
        """(key, space, cid, label, size) of the groups whose members are not all in one component."""
        named = groups.select("key", "space", "cid").join(self.labels.withColumnRenamed("node", "cid"), "cid", "left")
        named = named.select("key", "space", "cid", F.coalesce("component", "cid").alias("label"))
        open_ = (
            named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
            .filter("low != high").select("key", "size")
        )
        return named.join(open_, "key")

    def rest(self, open_: DataFrame) -> None:
        """Compare what is left of open groups: each member's nearest partner first, then all pairs that may still link."""
        for nearest in (True, False):
            rows = open_ if nearest else _written(self.unsettled(open_), "jaccard-rest", OPEN)
            sketched = rows.join(self.sketches, ["cid", "space"])
            blocks = F.ceil(F.col("size") * F.octet_length("sketch") / F.lit(MOST_HELD)).cast("int")
            sketched = sketched.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
            # A member of block b goes to every pair of blocks that b is in.
            sketched = sketched.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            sketched = sketched.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
            if not self.test(_across(sketched, self.percent, nearest)):
                return


OPEN = "key BIGINT, space INT, cid BIGINT, label BIGINT, size BIGINT"


def _split_by_cost(open_: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Open groups to compare as they are, and those whose members cost less to index again with neighbourhoods.

    With g members, one costs g / 2 comparisons in a group, and an entry per element and segment in the index.
    """
    lower, most = bands(percent)
    limit = [int(lower[k + 1] - 1 + (most[k] + 2) // 2) * 2 * COMPARISONS_PER_ENTRY for k in range(len(most))]
    spaces = pa.table({"space": pa.array(range(len(most)), pa.int32()), "most": pa.array(limit, pa.int64())})
    limits = open_.sparkSession.createDataFrame(spaces)
    judged = open_.join(F.broadcast(limits), "space")  # one row per size band
    return judged.filter("size <= most").drop("most"), judged.filter("size > most").drop("most")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, component_id (least id reachable by links) and `keeper`.

    Sets link when 100 * intersection >= percent * union. A null or wordless text has an empty set and links with
    nothing; a text of fewer words than a shingle has its whole sequence as its one shingle. Equal sets are all linked.
    A null id is never the least; a row whose component has no id has component_id null. `keeper` is true for the rows
    with the least (id, text hash) of their component, nulls last; rows equal in both are all true. An empty table gives
    no rows; other columns play no part.
    """
    spark = docs.sparkSession
    member = members(docs, doc_id, text, words)
    groups = _meetings(_entries(docs, text, words, percent))

    wanted = groups.select("cid").distinct()
    # One row stands for a class; its text is fetched by id and text hash, so only texts that met anything are kept.
    chosen = (
        member.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("text_hash", "doc_id")).alias("row"))
        .select("cid", F.col("row.text_hash").alias("h"), F.col("row.doc_id").alias("d"))
    )
    rows = docs.select(F.col(doc_id).cast("bigint").alias("rd"), F.xxhash64(text).alias("rh"), F.col(text).alias("text"))
    fetched = rows.join(chosen, (F.col("rh") == F.col("h")) & F.col("rd").eqNullSafe(F.col("d")))
    texts = _written(fetched.select("cid", "text").dropDuplicates(["cid"]), "jaccard-texts", "cid BIGINT, text STRING")

    search = _Search(spark, texts, words, percent)
    search.first_members(groups)
    near, crowded = _split_by_cost(_written(search.unsettled(groups), "jaccard-left", OPEN), percent)
    search.rest(near)
    crowd = crowded.select("cid", "space").distinct()
    if not crowd.isEmpty():
        again = _meetings(_crowded_entries(crowd, texts, words, percent))
        search.first_members(again)
        search.rest(_written(search.unsettled(again), "jaccard-crowded", OPEN))

    named = member.join(search.labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid")
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = named.filter(F.col("component").isNotNull()).groupBy(F.col("component").alias("of")).agg(F.min(order).alias("least"))
    found = named.join(least, F.col("component") == F.col("of"), "left")
    single = F.col("component").isNull()
    return found.select(
        "doc_id", "text_hash", "n_shingles",
        F.when(single, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (single | (order == F.col("least"))).alias("keeper"),
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns it came with; rows with empty sets all stay.

    Of rows that are equal in id and text one stays (which one of equal rows differs in other columns is not defined).
    """
    judged = jaccard_components(docs, doc_id, text, words, percent).filter("keeper")
    own, id, hash, full = unused(docs, "text_hash", "id", "hash", "filled")
    stays = judged.select(F.col("doc_id").alias(id), F.col("text_hash").alias(hash), (F.col("n_shingles") > 0).alias(full)).distinct()
    marked = docs.withColumn(own, F.xxhash64(f"`{text}`"))
    joined = marked.join(stays, (F.col(own) == F.col(hash)) & F.col(f"`{doc_id}`").cast("bigint").eqNullSafe(F.col(id)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    empty = joined.filter(~F.col(full)).select(*columns)
    filled = joined.filter(F.col(full)).dropDuplicates([id, hash]).select(*columns)
    return filled.unionByName(empty)
