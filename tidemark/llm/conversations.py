"""Repair of damaged conversations at least cost, by dynamic programming over runs of equal symbols.

A row's symbol is what the repair needs to know of it: the initial of its role (s, u, a or another one) and its fault
(must go, truncated, none). What a row costs from each of the four states of the role pattern `(s?(ua)+)?` to each of
them is a 4 x 4 matrix under (min, +). Equal symbols in a row are a run; the matrix of a run is a power of the
symbol's, built from cached squares, so a run of n rows takes log n products. Conversations are cut into segments of at most SEGMENT
rows, whose matrices are computed wherever the rows are; going backwards over the segments of a conversation gives the cost that
remains after each, and with it every segment's choices are unrolled on their own, cheapest first letter first.

Copies of a row must go wherever they stand: they add the same to every way and their letters follow the row's own.

Rows without texts do all of this. The texts cross one shuffle, to the task that joins the repaired conversation: its
hash is that of one string, so it has to be read in order by one task, which holds one segment and the audit at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 4096
FLUSH = 1 << 22

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 60

# States of the pattern: nothing yet, after s, after u, after a. Only the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # state after the user or assistant row that may come here
KEPT = {ord("s"): {START: SYSTEM}, ord("u"): {START: USER, SYSTEM: USER, ASSISTANT: USER}, ord("a"): {USER: ASSISTANT}}
WRITTEN = {USER: b"user", ASSISTANT: b"assistant"}

# A symbol is one byte: the initial (or x) in lower case, in upper case if truncated; GONE must be deleted.
GONE = ord("-")
END = (0, 2 * INSERT, INSERT, 0)


def _with_inserts(base: np.ndarray) -> np.ndarray:
    """Rows of `base` reached after up to three inserts; a fourth would be back at a state already seen."""
    best, states, cost = base.copy(), np.arange(4), 0
    for _ in range(3):
        states = np.array(NEXT)[states]
        cost += INSERT
        best = np.minimum(best, base[states] + cost)
    return best


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after it) of what may be done with a row itself, in the order of the letters."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        initial, extra = symbol | 32, TRUNCATED * (symbol & 32 == 0)
        if state in KEPT.get(initial, ()):
            found.append(("K", KEEP + extra, KEPT[initial][state]))
        found.append(("R", REROLE + extra, NEXT[state]))
    return found


def row_matrix(symbol: int) -> np.ndarray:
    """Least cost from state to state over one row and any inserts before it."""
    base = np.full((4, 4), FAR, np.int64)
    for state in range(4):
        for _, cost, after in choices(symbol, state):
            base[state, after] = min(base[state, after], cost)
    return _with_inserts(base)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


_squares: dict[tuple[int, int], np.ndarray] = {}  # nine symbols, at most 63 squares of each


def square(symbol: int, k: int) -> np.ndarray:
    """The matrix of 2^k equal rows."""
    found = _squares.get((symbol, k))
    if found is None:
        half = square(symbol, k - 1) if k else None
        found = _squares[symbol, k] = row_matrix(symbol) if half is None else product(half, half)
    return found


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of the runs."""
    codes = np.frombuffer(symbols, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
    return list(zip(codes[starts].tolist(), np.diff(np.append(starts, len(codes))).tolist()))


def run_matrix(symbol: int, n: int) -> np.ndarray:
    """The matrix of a run: the product of the squares in n's binary digits."""
    result, k = None, 0
    while n:
        if n & 1:
            result = square(symbol, k) if result is None else product(result, square(symbol, k))
        n, k = n >> 1, k + 1
    return result


def segment_matrix(symbols: bytes) -> np.ndarray:
    result = None
    for symbol, n in runs(symbols):
        matrix = run_matrix(symbol, n)
        result = matrix if result is None else product(result, matrix)
    return result


def ahead(matrix: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Least cost before rows with this matrix, if `rest` remains after them."""
    return np.minimum((matrix + rest[None, :]).min(1), FAR)


def unroll(symbols: bytes, state: int, rest: tuple[int, ...]) -> tuple[list[tuple[int, str, int]], int]:
    """The cheapest edits of a segment that starts in `state` and after which `rest` remains; ties by the least letter.

    Returns (inserts before it, letter, state after it) of each row, and the state at the end.
    """
    parts = runs(symbols)
    after = [np.array(rest, np.int64)]
    for symbol, n in reversed(parts):
        after.append(ahead(run_matrix(symbol, n), after[-1]))
    after.reverse()  # after[i]: what remains before run i
    done: list[tuple[int, str, int]] = []
    for place, (symbol, n) in enumerate(parts):
        costs = [after[place + 1].tolist()]  # what remains after the last row of the run, the one before, ...
        step = square(symbol, 0)
        for _ in range(n):
            costs.append(ahead(step, np.array(costs[-1])).tolist())
        for row in range(n, 0, -1):
            left, then, inserts = costs[row], costs[row - 1], 0
            while True:
                moves = {letter: to for letter, cost, to in choices(symbol, state) if cost + then[to] == left[state]}
                if INSERT + left[NEXT[state]] == left[state]:
                    moves["I"] = NEXT[state]
                letter = min(moves)
                state = moves[letter]
                if letter != "I":
                    break
                inserts += 1
            done.append((inserts, letter, state))
    return done, state



SHORT, MOST_REMEMBERED = 64, 1 << 14
_matrices: dict[tuple, np.ndarray] = {}
_unrolled: dict[tuple, tuple[list[tuple[int, str, int]], int]] = {}


def _remembered(cache: dict, compute: Callable, *key):
    """compute(*key), remembered for segments of up to SHORT rows; a full cache starts anew."""
    if len(key[0]) > SHORT:
        return compute(*key)
    found = cache.get(key)
    if found is None:
        if len(cache) >= MOST_REMEMBERED:
            cache.clear()
        found = cache[key] = compute(*key)
    return found


_DAMAGED = ("conv_id", "turn", "role", "digest")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation table (conv_id, turn, role, text) after repeatable damage, with `copies` of each.

    crc32 of `conv_id:turn` modulo 20 decides: 0 the row goes, 1 its text is emptied, 2 it loses its `.!?`, 3 it comes
    twice, 4 its role becomes user. Null roles and texts, and null numbers within the key, are one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = (F.crc32(key.cast("binary")) % 20).cast("int")
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    return conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).filter("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """One narrow row per distinct (conversation, turn, role, text) with its symbol, its number and whether it repeats another turn's."""
    blank = ~F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]"))
    whole = F.regexp_like(F.col("text"), F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    narrow = rows.select(
        "conv_id", "turn", "role", F.col("digest"), "copies", blank.alias("blank"), (~blank & ~whole).alias("truncated")
    )
    keys = [*_DAMAGED, "blank", "truncated"]
    distinct = narrow.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    # Only what occurs in several turns needs to know its first one; struct order puts null turns first.
    shared = (
        narrow.groupBy("conv_id", "role", "digest")
        .agg(F.min(F.struct(F.col("turn"))).alias("first"), F.max(F.struct(F.col("turn"))).alias("latest"))
        .filter(~F.col("first").eqNullSafe(F.col("latest")))
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"), F.lit(True).alias("many"))
    )
    found = distinct.join(shared, F.expr("conv_id <=> c AND role = r AND digest = d"), "left")
    again = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(F.lit("x"))
    symbol = F.when(F.col("blank") | again, F.lit("-")).when(F.col("truncated"), F.upper(initial)).otherwise(initial)
    return found.select(*_DAMAGED, "copies", initial.alias("initial"), symbol.alias("symbol"), "blank")


_SEGMENT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("role", pa.string()),
        ("digest", pa.binary()),
        ("place", pa.int64()),  # of the segment within its conversation and range
        ("symbols", pa.binary()),
        ("copies", pa.binary()),
        ("matrix", pa.list_(pa.int64())),
        ("blank", pa.int64()),
        ("duplicate", pa.int64()),
        ("truncated", pa.int64()),
        ("illegal", pa.int64()),
        ("ends", pa.string()),  # first and last initial
        ("least", pa.int64()),
        ("most", pa.int64()),
        ("turns", pa.int64()),  # distinct turns
    ]
)
_SEGMENT_SQL = (
    "conv_id long, turn long, role string, digest binary, place long, symbols binary, copies binary, matrix array<long>, blank long, "
    "duplicate long, truncated long, illegal long, ends string, least long, most long, turns long"
)
LEGAL = {"su", "ua", "au"}


def _segment(rows: list[tuple], place: int) -> tuple:
    """Summary of the sorted rows (conv_id, turn, role, digest, copies, initial, symbol, blank) of one segment."""
    copies = np.array([r[4] for r in rows], np.int64)
    initials = [r[5] for r in rows]
    symbols = "".join(r[6] for r in rows).encode()
    matrix = _remembered(_matrices, segment_matrix, symbols).ravel().tolist()
    illegal = int(copies.sum()) - len(rows) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    blank = sum(r[4] for r in rows if r[7])
    duplicate = sum(r[4] - (r[6] != "-") for r in rows if not r[7])
    turns = [r[1] for r in rows if r[1] is not None]
    return (
        *rows[0][:4],
        place,
        symbols,
        copies.tobytes(),
        matrix,
        blank,
        duplicate,
        sum(r[6].isupper() for r in rows),
        illegal,
        initials[0] + initials[-1],
        turns[0] if turns else None,
        turns[-1] if turns else None,
        len(set(turns)),
    )


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a range of sorted rows; their number within the range keeps them apart."""

    def found() -> Iterator[tuple]:
        held: list[tuple] = []
        place = 0
        for row in _rows(batches):
            if held and (held[0][0] != row[0] or len(held) == SEGMENT):
                yield _segment(held, place)
                place += 1
                held = []
            held.append(row)
        if held:
            yield _segment(held, place)

    return _batches(found(), _SEGMENT, lambda row: 400 + 9 * len(row[5]))


_HEADER_SQL = _SEGMENT_SQL.replace("matrix array<long>", "rest array<long>")
_HEADER = pa.schema([f if f.name != "matrix" else pa.field("rest", pa.list_(pa.int64())) for f in _SEGMENT])


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, last one of a conversation first, with the cost that remains after each in place of their matrix."""

    def found() -> Iterator[tuple]:
        rest, last = END, object()
        for row in _rows(batches):
            if row[0] != last:
                rest, last = END, row[0]
            yield (*row[:7], list(rest), *row[8:])
            rest = tuple(ahead(np.array(row[7], np.int64).reshape(4, 4), np.array(rest, np.int64)).tolist())

    return _batches(found(), _HEADER, lambda row: 400 + 9 * len(row[5]))


_RESULT = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Conversation:
    """One conversation, given as its segments in order, each followed by its rows with text."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.state, self.cost, self.audit = START, 0, []
        self.hash, self.lines = hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None
        self.last = ""
        self.rows: Iterator = iter(())
        self.key = None

    def segment(self, symbols, copies, rest, blank, duplicate, truncated, illegal, ends, least, most, turns) -> None:
        done, state = _remembered(_unrolled, unroll, symbols, self.state, tuple(rest))
        if not self.audit:  # what remains before the first segment is the whole cost but for copies
            matrix = _remembered(_matrices, segment_matrix, symbols)
            self.cost += int(ahead(matrix, np.array(rest, np.int64))[START])
        extra = (np.frombuffer(copies, np.int64) - 1).tolist()
        self.cost += DELETE * sum(extra)
        self.audit.append("".join("I" * inserts + letter + "D" * n for (inserts, letter, _), n in zip(done, extra)))
        self.rows, self.state = iter(done), state
        self.illegal += illegal + (self.last != "" and self.last + ends[0] not in LEGAL)
        self.last = ends[-1]
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if turns:
            self.turns += turns - (self.most == least)
            self.least, self.most = least if self.least is None else self.least, most

    def line(self, role: bytes, text: bytes) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.hash.update(role + b":" + text)
        self.lines += 1

    def insert(self, state: int) -> int:
        self.line(WRITTEN[NEXT[state]], b"")
        return NEXT[state]

    def row(self, key: tuple, role: bytes, text: bytes, state: int) -> int:
        """Write what becomes of a row that comes in `state`; returns the state after it."""
        if key == self.key:  # a copy, deleted already
            return state
        self.key = key
        inserts, letter, after = next(self.rows)
        for _ in range(inserts):
            state = self.insert(state)
        if letter == "K":
            self.line(role, text)
        elif letter == "R":
            self.line(WRITTEN[after], text)
        return after

    def finish(self, state: int) -> tuple:
        ends = 0
        while END[state]:
            state = self.insert(state)
            ends += 1
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (
            self.conv_id,
            gaps,
            self.blank,
            self.duplicate,
            self.truncated,
            self.illegal,
            self.cost,
            "".join(self.audit) + "I" * ends,
            self.hash.hexdigest(),
        )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        now: _Conversation | None = None
        state = START
        for conv_id, turn, role, digest, kind, text, header in _rows(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.finish(state)
                now, state = _Conversation(conv_id), START
            if kind == 1:
                now.segment(**header)
            elif kind == 2:
                state = now.row((turn, role, digest), role.encode(), text, state)
        if now is not None:
            yield now.finish(state)

    return _batches(found(), _RESULT, lambda row: 200 + len(row[7]))


def repair_conversations(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """What is wrong with each conversation, its cheapest repair, and the hash of the repaired text.

    `rows` has conv_id and turn (longs, nulls allowed), role and text (no nulls) and copies (how often the row comes, 1 or more);
    `all_ids` the column conv_id, of which each value gets one row, null too; repeated rows and other columns are
    ignored there. Rows are taken by turn, nulls first, those of one turn by role and SHA-256 of the text, so that equal
    rows are neighbours. A conversation without rows has zeros, an empty audit and the hash of the empty string.
    """
    rows = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text", "copies"
    )
    narrow = _symbols(rows).select(*_DAMAGED, "copies", "initial", "symbol", "blank")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = (
        narrow.repartitionByRange(ranges, *_DAMAGED).sortWithinPartitions(*_DAMAGED).mapInArrow(_cut, _SEGMENT_SQL)
    )
    # A segment's key is that of its first row, so keys order the segments of one conversation.
    order = [F.col(c).desc_nulls_last() for c in _DAMAGED]
    headers = segments.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_backwards, _HEADER_SQL)
    fields = [c for c in _HEADER.names if c not in (*_DAMAGED, "place")]
    no_header = F.lit(None).cast(T.StructType([headers.schema[c] for c in fields]))
    no_text = F.lit(None).cast("binary")
    all_rows = (
        headers.select(*_DAMAGED, F.lit(1).alias("kind"), no_text.alias("text"), F.struct(*fields).alias("header"))
        .unionAll(rows.select(*_DAMAGED, F.lit(2), F.col("text").cast("binary"), no_header))
        .unionAll(
            all_ids.groupBy("conv_id").agg(F.lit(0).alias("kind")).select(
                "conv_id", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("binary"), "kind", no_text, no_header
            )
        )
    )
    return all_rows.repartition("conv_id").sortWithinPartitions(*_DAMAGED, "kind").mapInArrow(_joined, RESULT)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Damage a table of conversations and repair it again; see `damage` and `repair_conversations`.

    Every conv_id of the table gets its row, also if all its rows were dropped. Repeated rows are kept apart by the damage
    and meet as copies in the repair. Empty texts are blank; very long ones are read whole, by the task of their
    conversation. An empty table gives no rows; columns other than conv_id, turn, role and text are not read.
    """
    return repair_conversations(damage(conversations), conversations)
