"""Embedding near-duplicates with randomised-rotation binary codes.

Unit vectors are turned by random rotations; the signs of the turned coordinates are their binary code. Near vectors
meet in tables, whose number follows from the wanted recall at the threshold angle and from the number of vectors. There
are two levels of them. A few tables deal the vectors into large cells, each to the signs and places of its two largest
turned coordinates; only they cross a shuffle. Inside a cell, in memory, groups of sign bits are tables with buckets of
about as many strangers at any size, or all pairs of a small cell are looked at. Signs that differ in a sketch rule out
most strangers, the first rotation's code estimates the inner products of the others: <code, other> / <code, own> is
unbiased, <code, own> is the correction factor, and its confidence bound decides which pairs are computed exactly, in
double precision.

Equal vectors are one class with a count. A large cell is cut into blocks and every pair of blocks is a group of its
own. A pair is counted in the first table in which it meets, so counts are exact without ever writing pairs: a group
gives each vector its number of links and the least connected vector, nothing more. Whether a pair met before is read
from cells that come out alike wherever they are computed. The tables are gone through in passes, and the shuffle of a
pass is given up with it, so the disk that is needed does not grow with their number.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemark.llm.components import components
from tidemark.llm.memory import give_back
from tidemark.session import FREE_SHUFFLES, BATCH_BYTES, settings, work_dir

THRESHOLD = 0.9
RECALL = 0.9999
STRANGERS = 16
BLOCK = 1 << 18  # most vectors, and most bytes of vectors, that are compared in one place
BLOCK_BYTES = 1 << 26
DENSE = 2048  # up to so many vectors, all pairs of a group are looked at
CELLS = 16  # parts of the vectors that a cell has at most, where they are DENSE / 2 vectors or more
SAMPLES = 40_960
PASS_BYTES = 1 << 26  # vectors dealt in a pass: so many bytes, or the whole table PASS_SHARE times
PASS_SHARE = 1
DEALT_BYTES = 1 << 23  # vectors of a task that are dealt at a time
TILE = 256
SHIFTED = 1 << 14
PAIRS = 1 << 15
SPREADS = 4.5  # standard deviations of the estimate that the bound allows
SKETCH = 128  # signs of a sketch
MISSED = 1e-6  # share of pairs just at the threshold that the sketch may rule out
GRAIN = 1 << 20
SEED = 20_240_101


def plan_tables(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """Sign bits per table and number of tables for a pair just at the threshold to meet with probability `recall`."""
    bits = max(2, math.ceil(math.log2(max(vectors, 2) / STRANGERS)))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def plan_cells(vectors: int, size: int, most: int, threshold: float, recall: float) -> tuple[int, int]:
    """Coordinates and number of the tables that deal vectors into cells of about half of `most`, or fewer of a small table."""
    coordinates = max(2, math.ceil(vectors / max(1, min(most // 2, max(DENSE // 2, vectors // CELLS)))))
    apart = max(1e-9, 1 - _share_met(size, coordinates, threshold))
    return coordinates, max(1, math.ceil(math.log(1 - recall) / math.log(apart)))


@lru_cache(maxsize=64)
def _share_met(size: int, coordinates: int, threshold: float) -> float:
    """The share of pairs just at the threshold that have a cell of a table in common, drawn at random, less two standard deviations."""
    draw, met = np.random.default_rng([SEED, size, coordinates]), []
    for _ in range(SAMPLES // 2048):
        one, aside = draw.standard_normal((2, 2048, size))
        one /= np.linalg.norm(one, axis=1, keepdims=True)
        aside -= (one * aside).sum(axis=1, keepdims=True) * one
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-9)
        other = threshold * one + math.sqrt(1 - threshold**2) * aside
        a, b = (cells_of(v, coordinates, 1)[:, 0] for v in (one, other))
        met.append((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean())
    share = float(np.mean(met))
    return max(0.0, share - 2 * math.sqrt(share * (1 - share) / SAMPLES))


@lru_cache(maxsize=8)
def most_different(signs: int, threshold: float) -> int:
    """The number of differing signs that a pair just at the threshold exceeds with probability MISSED at most."""
    differ = math.acos(threshold) / math.pi
    left = 1.0
    for n in range(signs):
        left -= math.comb(signs, n) * differ**n * (1 - differ) ** (signs - n)
        if left <= MISSED:
            return n
    return signs


@lru_cache(maxsize=8)
def _rotations(size: int, count: int) -> np.ndarray:
    """`count` random orthonormal matrices side by side; equal in every process."""
    draw = np.random.default_rng([SEED, size])
    turns = []
    for _ in range(count):
        q, r = np.linalg.qr(draw.standard_normal((size, size)))
        turns.append(q * np.sign(np.diag(r)))
    return np.concatenate(turns, axis=1)


@lru_cache(maxsize=32)
def _directions(size: int, skip: int, count: int, kind: str) -> np.ndarray:
    """`count` columns of the rotations after the first `skip` columns, as rows; whole numbers of 1 / GRAIN if `kind` is exact."""
    turns = _rotations(size, -(-(skip + count) // size))[:, skip : skip + count].T
    return np.ascontiguousarray(np.rint(turns * GRAIN) if kind == "exact" else turns.astype(np.float32))


def _unit(raw: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return raw.astype(np.float64) / norm[:, None]


def _norms(raw: np.ndarray) -> np.ndarray:
    found = [np.linalg.norm(raw[k : k + PAIRS].astype(np.float64), axis=1) for k in range(0, len(raw), PAIRS)]
    return np.concatenate(found or [np.zeros(0)])


def cells_of(unit: np.ndarray, coordinates: int, tables: int, first: int = 0) -> np.ndarray:
    """The two cells (vector, table, 2) of each vector in each of so many tables from the first one on, the lower first.

    Vectors and rotations are whole numbers of 1 / GRAIN here, so the sums are exact in double precision and the cells
    of a vector are the same in every batch, task and pass (for up to 2^13 components).
    """
    size = unit.shape[1]
    turns = _directions(size, size + coordinates * first, coordinates * tables, "exact")  # the first rotation is the code's own
    with np.errstate(invalid="ignore"):
        turned = (np.rint(unit * GRAIN) @ turns.T).reshape(len(unit) * tables, coordinates)
    length, rows, found = np.abs(turned), np.arange(len(turned)), []
    for _ in range(2):
        at = length.argmax(axis=1)
        found.append(2 * at + (turned[rows, at] > 0))
        length[rows, at] = -1
    return np.sort(np.stack(found, axis=1), axis=1).astype(np.int32).reshape(len(unit), tables, 2)


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, their codes (signs over the root of the dimension) and the correction factors."""
    turned = unit @ _rotations(unit.shape[1], 1)
    code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned, code, (code * turned).sum(axis=1)


def _spread(factor: np.ndarray, size: int) -> np.ndarray:
    return SPREADS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, size - 1))


def possible(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose inner product may reach the threshold: rows by their codes, columns by their turned vectors."""
    return (code @ turned.T) / factor[:, None] + _spread(factor, code.shape[1])[:, None] >= threshold


def _dense_pairs(unit: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a small group that the code's bound leaves open."""
    turned, code, factor = codes_of(unit)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    apart = len(right) > 0
    for at in range(0, len(left), TILE):
        rows = left[at : at + TILE]
        columns = right if apart else left[at:]
        a, b = np.nonzero(possible(code[rows], factor[rows], turned[columns], threshold))
        a, b = rows[a], columns[b]
        if not apart:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), PAIRS):
            yield a[k : k + PAIRS], b[k : k + PAIRS]


def _signs(raw: np.ndarray, norm: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (table, vector) and sketches (word, vector) of a large group; they are compared within it only."""
    count, size = raw.shape
    turns, kind = _directions(size, size, SKETCH + bits * tables, "float"), np.dtype(np.uint32 if bits > 16 else np.uint16)
    own = turns[SKETCH:].reshape(bits, tables, size).transpose(1, 0, 2).reshape(bits * tables, size)  # a table's bits are of different rotations
    turns = np.ascontiguousarray(np.concatenate([turns[:SKETCH], own]).T)
    keys, sketch = np.empty((tables, count), kind), np.empty((SKETCH // 64, count), np.uint64)
    for k in range(0, count, 2048):
        few = slice(k, min(k + 2048, count))
        with np.errstate(invalid="ignore"):
            turned = _unit(raw[few], norm[few]).astype(np.float32) @ turns
        sketch[:, few] = np.packbits(turned[:, :SKETCH] > 0, axis=1).view(np.uint64).T
        padded = np.zeros((len(turned), tables, 8 * kind.itemsize), bool)
        np.greater(turned[:, SKETCH:].reshape(-1, tables, bits), 0, out=padded[:, :, :bits])
        keys[:, few] = np.packbits(padded.reshape(len(turned), -1), axis=1, bitorder="little").view(kind).T
    return keys, sketch


def _lanes(keys: np.ndarray) -> np.ndarray:
    """Buckets of up to four tables as the lanes of one number."""
    lanes = np.zeros((keys.shape[1], 4), np.uint16)
    lanes[:, : len(keys)] = keys.T
    return lanes.view(np.uint64)[:, 0]


def _meet(a: np.ndarray, b: np.ndarray, lanes: int) -> np.ndarray:
    """Whether one of the first lanes is equal."""
    differ = a ^ b
    if lanes < 4:
        differ |= np.uint64((1 << 64) - (1 << 16 * lanes))
    return ((differ - np.uint64(0x0001000100010001)) & ~differ & np.uint64(0x8000800080008000)) != 0


def _same_bucket(key: np.ndarray, sketch: list[np.ndarray], most: int, before: np.ndarray, lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in a sorted table of pairs that share a bucket and have sketches alike.

    before: buckets of the latest tables; most pairs that have met already are left out by them.
    """
    count = len(key)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, count)
    sizes = np.diff(ends, prepend=0)
    behind = np.repeat(ends, sizes) - np.arange(count) - 1  # members of the bucket after this one
    # Most members of most buckets are met by moving the table against itself, a stretch that stays in the cache at a time.
    alive = count - np.cumsum(np.bincount(np.minimum(behind, 255), minlength=256))  # with more behind them than the index
    shifts = int(np.count_nonzero(4 * alive[:255] > count))
    for at in range(0, count, SHIFTED):
        for step in range(1, shifts + 1):
            n = min(SHIFTED, count - at - step)
            if n <= 0:
                break
            differ = np.bitwise_count(sketch[0][at : at + n] ^ sketch[0][at + step : at + step + n])
            for word in sketch[1:]:
                differ += np.bitwise_count(word[at : at + n] ^ word[at + step : at + step + n])
            a = np.flatnonzero(differ <= most) + at
            if len(a):
                a = a[(behind[a] >= step) & ~_meet(before[a], before[a + step], lanes)]
                yield a, a + step
    rest = np.flatnonzero(behind > shifts)
    many = behind[rest] - shifts
    upto = np.cumsum(many)
    k = 0
    while k < len(rest):  # whole positions, about so many pairs at once; a position has fewer than a group has vectors
        to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + (1 << 16), "right")))
        n = many[k:to]
        a = np.repeat(rest[k:to], n)
        b = a + (shifts + 1) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        differ = np.bitwise_count(sketch[0][a] ^ sketch[0][b])
        for word in sketch[1:]:
            differ += np.bitwise_count(word[a] ^ word[b])
        near = np.flatnonzero(differ <= most)
        a, b = a[near], b[near]
        near = ~_meet(before[a], before[b], lanes)
        yield a[near], b[near]
        k = to


def _table_pairs(
    raw: np.ndarray, norm: np.ndarray, side: np.ndarray, threshold: float, recall: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a large group that meet in a bucket, each in the first table only, and have sketches alike."""
    bits, tables = plan_tables(len(raw), threshold, recall)
    keys, sketch = _signs(raw, norm, bits, tables)
    apart, most = bool(side.any()), most_different(SKETCH, threshold)

    def new(held: list[tuple[np.ndarray, np.ndarray]], table: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([pair[k] for pair in held]) for k in (0, 1))
        if apart:
            across = side[a] != side[b]
            a, b = a[across], b[across]
        for earlier in keys[:table]:
            if not len(a):
                break
            first = earlier[a] != earlier[b]
            a, b = a[first], b[first]
        return a, b

    for table, key in enumerate(keys):
        order = np.argsort(key, kind="stable")
        held, count = [], 0
        lanes = min(table, 4) if key.dtype == np.uint16 else 0
        before = _lanes(keys[table - lanes : table])[order]
        for a, b in _same_bucket(key[order], [word[order] for word in sketch], most, before, lanes):
            held.append((order[a], order[b]))
            count += len(a)
            if count > 1 << 19:
                yield new(held, table)
                held, count = [], 0
        if count:
            yield new(held, table)


def _near_pairs(
    raw: np.ndarray, side: np.ndarray, threshold: float, recall: float, most_dense: int, coordinates: int, table: int, cell: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a group that reach the threshold and have not met in an earlier table, or in a lower cell of this one."""
    norm = _norms(raw)
    small = len(raw) <= most_dense
    if small:
        found = _dense_pairs(_unit(raw, norm), side, threshold)
    else:
        found = _table_pairs(raw, norm, side, threshold, recall)
    cells, known = np.empty((len(raw), table + 1, 2), np.int32), np.zeros(len(raw), bool)
    for a, b in found:
        for k in range(0, len(a), PAIRS):
            x, y = a[k : k + PAIRS], b[k : k + PAIRS]
            named = np.zeros(len(raw), bool)
            named[x] = named[y] = True
            asked = np.flatnonzero(named & ~known)
            for j in range(0, len(asked), 1024):
                few = asked[j : j + 1024]
                cells[few] = cells_of(_unit(raw[few], norm[few]), coordinates, table + 1)
            known[asked] = True
            of_x = cells[x]
            common = (of_x[:, :, :, None] == cells[y][:, :, None, :]).any(axis=3)
            common[:, table] &= of_x[:, table] < cell
            new = ~common.any(axis=(1, 2))
            x, y = x[new], y[new]
            if not len(x):
                continue
            left, right = _unit(raw[x], norm[x]), _unit(raw[y], norm[y])
            if not small:
                _, code, factor = codes_of(left)
                turned = right @ _rotations(raw.shape[1], 1)
                may = np.einsum("ij,ij->i", code, turned) / factor + _spread(factor, raw.shape[1]) >= threshold
                x, y, left, right = x[may], y[may], left[may], right[may]
            near = np.einsum("ij,ij->i", left, right) >= threshold
            if near.any():
                yield x[near], y[near]


def _least_reachable(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each index is connected to."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _judged(pairs: Iterator[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each index, and the least index it is connected to."""
    links, label = np.zeros(len(weight), np.int64), np.arange(len(weight))
    for a, b in pairs:
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        a, b = label[a], label[b]
        open_ = a != b
        if open_.any():
            some, at = np.unique(np.concatenate([a[open_], b[open_]]), return_inverse=True)
            low = some[_least_reachable(len(some), at[: len(at) // 2], at[len(at) // 2 :])]
            label[some] = low
            label = label[label]
    return links, label


def _binary(data: np.ndarray, ends: np.ndarray, valid: pa.Buffer | None = None) -> pa.Array:
    """Binary values that lie one behind the other; ends: bytes up to the end of each."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _content(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all values of a binary column without nulls, one behind the other, without a copy."""
    wide = pa.types.is_large_binary(column.type)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _kind(rows: DataFrame, vector: str) -> str:
    """The number type that keeps the components as they are: float for floats, else double."""
    return "<f4" if isinstance(rows.select(vector).schema[0].dataType.elementType, FloatType) else "<f8"


def _packed(rows: DataFrame, vec_id: str, vector: str, kind: str) -> DataFrame:
    """vec_id and vec: the components as bytes with -0.0 as 0.0, so that equal vectors have equal bytes; null if not usable."""

    def pack(column: pa.Array) -> pa.Array:
        numbers = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)
        ends = np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)) * np.dtype(kind).itemsize
        valid = np.packbits(column.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
        return _binary(numbers.view(np.uint8), ends, pa.py_buffer(valid))

    element = "float" if kind == "<f4" else "double"
    wanted = rows.select(
        F.col(vec_id).alias("vec_id"), F.when(usable(vector), F.col(vector).cast(f"array<{element}>")).alias("__vector")
    )
    return wanted.select("vec_id", F.arrow_udf(pack, "BINARY")("__vector").alias("vec"))


def _key() -> F.Column:
    return F.unhex(F.sha2("vec", 256))


def _classes(rows: DataFrame, vec_id: str, vector: str, kind: str) -> DataFrame:
    """One row per distinct usable vector: cid, dim, n (rows), least (id), vec (its components as bytes)."""
    spark = rows.sparkSession
    grouped = (
        _packed(rows, vec_id, vector, kind)
        .filter("vec IS NOT NULL")
        .groupBy("vec")
        .agg(F.count("*").alias("n"), F.min(F.col("vec_id").cast("bigint")).alias("least"))
        .withColumn("dim", (F.octet_length("vec") / F.lit(np.dtype(kind).itemsize)).cast("int"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    path = work_dir(spark, "vector-classes")
    grouped.write.parquet(path)  # the numbers must not change when a task is repeated
    return spark.read.schema("vec BINARY, n BIGINT, least BIGINT, dim INT, cid BIGINT").parquet(path)


def usable(vector: str) -> F.Column:
    """Not null, with finite components only and not the zero vector."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _by_dim(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """dim, vectors, cid and n, about DEALT_BYTES of vectors at a time."""
    held: dict[int, list[pa.RecordBatch]] = defaultdict(list)
    size: dict[int, int] = defaultdict(int)

    def give(dim: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        parts, size[dim] = held.pop(dim), 0
        raw = np.concatenate([_content(p.column("vec"), kind) for p in parts]).reshape(-1, dim)
        return dim, raw, *(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("cid", "n"))

    for batch in batches:
        for dim in pa.compute.unique(batch.column("dim")).to_pylist():
            part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
            held[dim].append(part)
            size[dim] += part.num_rows * dim * np.dtype(kind).itemsize
            if size[dim] >= DEALT_BYTES:
                yield give(dim)
        if sum(size.values()) >= 2 * DEALT_BYTES:
            for dim in list(held):
                yield give(dim)
    for dim in list(held):
        yield give(dim)


def _mixed(cid: np.ndarray) -> np.ndarray:
    """A hash of class numbers, which say where a class was written."""
    x = cid.astype(np.uint64)
    for turn in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(turn)
    return x ^ (x >> np.uint64(31))


KEYS = ["dim", "tab", "cell", "b0", "b1"]
DEALT = "dim INT, tab INT, cell INT, b0 INT, b1 INT, side INT, cids BINARY, ns BINARY, vecs BINARY"
FOUND = "cid BIGINT, links BIGINT, root BIGINT"


def _dealt(
    dim: int, table: int, cell: np.ndarray, b0: np.ndarray, b1: np.ndarray, side: int, at: np.ndarray, cid: np.ndarray, n: np.ndarray, raw: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """A row for each group, with the numbers of all its vectors; at: the vectors that go to the cells and blocks."""
    if not len(at):
        return
    order = np.lexsort((b1, b0, cell)) if b0.any() or b1.any() else np.argsort(cell, kind="stable")
    columns = [c[order] for c in (cell, b0, b1)]
    change = np.zeros(len(order), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(change)
    ends = np.append(begin[1:], len(order))
    dim_, table_, side_ = (pa.array(np.full(len(begin), v, np.int32)) for v in (dim, table, side))
    arrays = [dim_, table_, *(pa.array(c[begin].astype(np.int32)) for c in columns), side_]
    for numbers, each in ((cid, 1), (n, 1), (raw, dim)):
        data = numbers[at[order]].reshape(-1)
        arrays.append(_binary(data.view(np.uint8), ends * each * data.itemsize))
    yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "side", "cids", "ns", "vecs"])


def _passes(tables: int, plans: dict[int, tuple[int, int]], weights: dict[int, int], cut: dict[tuple[int, int, int], tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """The (table, distance between blocks, parity of the cell) to go through, a list for each pass.

    Distance 0 takes every vector to its cell, or to its own block of a cell that is cut; distance d the vectors of cut
    cells to the pairs of blocks that are d apart. weights: bytes of all vectors of a length; cut: blocks and bytes.
    """
    most = max(PASS_BYTES, PASS_SHARE * sum(weights.values()))
    out: list[list[tuple[int, int, int]]] = []
    full = most
    for table, odd in ((t, o) for t in range(tables) for o in (0, 1)):
        here = [(blocks, size) for (_, tab, cell), (blocks, size) in cut.items() if tab == table and cell % 2 == odd]
        for apart in range(1 + max([0, *(blocks // 2 for blocks, _ in here)])):
            # Every vector goes to two cells, about half of which are odd.
            size = 2 * sum(s for blocks, s in here if blocks // 2 >= apart) if apart else sum(weights[d] for d, p in plans.items() if p[1] > table)
            if full + size > most * (1 + 1e-9):
                out.append([])
                full = 0
            out[-1].append((table, apart, odd))
            full += size
    return out


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (least id reachable), kept (it is that least id).

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of different
    length. Equal vectors are all linked with each other. A pair just at the threshold is met with probability `recall`,
    nearer ones more surely; none below the threshold is linked. A null id is no candidate for the least id; a row
    whose component has no id keeps null and kept false. Rows with one id and different vectors are separate vectors.
    An empty table gives no rows; other columns play no part.
    """
    spark, kind = rows.sparkSession, _kind(rows, vector)
    with settings(spark, {FREE_SHUFFLES: "true", BATCH_BYTES: spark.conf.get(BATCH_BYTES, None) or "4m"}):
        per_class = _linked_classes(_classes(rows, vec_id, vector, kind), kind, threshold, recall)
    return (
        _packed(rows, vec_id, vector, kind)
        .select("vec_id", _key().alias("key"))
        .join(per_class, "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("bigint").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _linked_classes(classes: DataFrame, kind: str, threshold: float, recall: float) -> DataFrame:
    """key (of the vector), n_links and component_id of every class."""
    spark, width = classes.sparkSession, np.dtype(kind).itemsize
    half = 1 - (1 - recall) / 2  # of the cells, and of the tables inside a cell
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().filter("count > 1").collect()}
    most = {dim: max(2, min(BLOCK, BLOCK_BYTES // (dim * width))) for dim in counts}
    plans = {dim: plan_cells(count, dim, most[dim], threshold, half) for dim, count in counts.items()}
    weights = {dim: count * dim * width for dim, count in counts.items()}
    most_dense = DENSE

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for dim, raw, _, _ in _by_dim(batches, kind):
            if dim in plans:
                for k in range(0, len(raw), 2048):
                    few = raw[k : k + 2048]
                    for table, cells in enumerate(cells_of(_unit(few, _norms(few)), *plans[dim]).transpose(1, 0, 2)):
                        at, n = np.unique(cells, return_counts=True)
                        old = sums.get((dim, table))
                        if old is not None:
                            at, back = np.unique(np.concatenate([old[0], at]), return_inverse=True)
                            n = np.bincount(back, np.concatenate([old[1], n])).astype(np.int64)
                        sums[dim, table] = at, n
        for (dim, table), (at, n) in sums.items():
            same = [pa.array(np.full(len(at), v, np.int32)) for v in (dim, table)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(at), pa.array(n)], names=["dim", "tab", "cell", "size"])

    # Only cells that must be cut are known to the driver: fewer than tables x vectors / block.
    sizes = classes.select("vec", "n", "dim", "cid").mapInArrow(count_cells, "dim INT, tab INT, cell INT, size BIGINT")
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("dim")) if most else F.lit(2)
    large = sizes.groupBy("dim", "tab", "cell").agg(F.sum("size").alias("size")).filter(F.col("size") > limit).collect()
    cut = {(r.dim, r.tab, r.cell): (-(-2 * r["size"] // most[r.dim]), r["size"] * r.dim * width) for r in large}
    blocks_of = {(dim, table): {} for dim, table, _ in cut}
    for (dim, table, cell), (blocks, _) in cut.items():
        blocks_of[dim, table][cell] = blocks

    def found_in(pass_: list[tuple[int, int, int]]) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dim, raw, cid, n in _by_dim(batches, kind):
                if dim not in plans:
                    continue
                hashed, tables = _mixed(cid), range(pass_[0][0], min(pass_[-1][0] + 1, plans[dim][1]))
                if not tables:
                    continue
                few = [raw[k : k + 2048] for k in range(0, len(raw), 2048)]
                cells = np.concatenate([cells_of(_unit(x, _norms(x)), plans[dim][0], len(tables), tables.start) for x in few])
                for table, apart, odd in pass_:
                    if table not in tables:
                        continue
                    here, split = cells[:, table - tables.start], blocks_of.get((dim, table), {})
                    at, which = np.nonzero(here % 2 == odd)
                    cell = here[at, which]
                    blocks = np.ones(len(at), np.int64)
                    for one, many in split.items():
                        blocks[cell == one] = many
                    own = (hashed[at] % blocks.astype(np.uint64)).astype(np.int64)
                    if not apart:
                        yield from _dealt(dim, table, cell, own, own, 0, at, cid, n, raw)
                        continue
                    for way in (1, -1):
                        # Blocks half of an even number apart are each other's partners both ways: one of them is enough.
                        there = (2 * apart < blocks) | ((2 * apart == blocks) & ((own < apart) if way == 1 else (own >= apart)))
                        some = np.flatnonzero(there & (blocks > 1))
                        first = own[some] if way == 1 else (own[some] - apart) % blocks[some]
                        yield from _dealt(dim, table, cell[some], first, (first + apart) % blocks[some], int(way == -1), at[some], cid, n, raw)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, KEYS):
                dim, table, cell = (group.column(c)[0].as_py() for c in ("dim", "tab", "cell"))
                cid, weight, raw = (_content(group.column(c).combine_chunks(), k) for c, k in (("cids", "<i8"), ("ns", "<i8"), ("vecs", kind)))
                if len(cid) < 2:
                    continue
                lengths = pa.compute.binary_length(group.column("cids")).to_numpy() // 8
                side = np.repeat(group.column("side").to_numpy(), lengths)
                pairs = _near_pairs(raw.reshape(len(cid), dim), side, threshold, half, most_dense, plans[dim][0], table, cell)
                links, label = _judged(pairs, weight)
                some = np.flatnonzero(links)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[label[some]])], names=["cid", "links", "root"])
            give_back()

        dealt = classes.select("vec", "n", "dim", "cid").mapInArrow(place, DEALT)
        return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(judge, FOUND)

    paths = []
    for pass_ in _passes(max([0, *(tables for _, tables in plans.values())]), plans, weights, cut):
        paths.append(work_dir(spark, "vector-links"))
        found_in(pass_).write.parquet(paths[-1])
    found = spark.read.schema(FOUND).parquet(*paths) if paths else spark.range(0).select(F.col("id").alias("cid"), F.col("id").alias("links"), F.col("id").alias("root"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    member = components(found, "cid", "root")
    judged = (
        classes.select(_key().alias("key"), "n", "least", "cid")
        .join(links, "cid", "left")
        .join(member.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    ids = judged.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = judged.join(ids, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    path = work_dir(spark, "vector-judged")
    per_class.write.parquet(path)
    return spark.read.schema("key BINARY, n_links BIGINT, component_id BIGINT").parquet(path)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batch boundaries."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cuts = np.flatnonzero(change)
        begin = 0
        for cut in cuts.tolist():
            held.append(batch.slice(begin, cut - begin))
            yield pa.Table.from_batches(held).combine_chunks()
            held, begin = [], cut
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
