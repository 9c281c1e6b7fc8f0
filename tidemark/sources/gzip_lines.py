"""Lines of gzip files, framed byte for byte, read by one task or, from restart points, by several.

A restart point is a place where reading can begin without what came before: the start of a gzip member, or a
byte-aligned flush inside one together with the 32 KB of text before it. A file that has neither is read by several
tasks as well: each inflates from the last restart point before its part, which is cheap, and frames and parses only
its own part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READ = 1 << 20
BATCH = 1 << 22
WINDOW = 1 << 15
FLUSH = b"\x00\x00\xff\xff"  # an empty stored block: what follows begins at a byte
PROOF = 1 << 12  # raw bytes that a flush must reproduce to count as one


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def open_file(uri: str) -> Iterator[pa.NativeFile]:
    system, path = _system(uri)
    with system.open_input_file(path) as file:
        yield file


# Inflating ---------------------------------------------------------------------------------------------


@dataclass
class Restart(InputPartition):
    """Where inflating can begin: compressed and raw offset, and the raw bytes before (None: a gzip header follows)."""

    packed_at: int
    raw_at: int
    window: bytes | None


BEGIN = Restart(0, 0, None)


def inflate(file: pa.NativeFile, start: Restart) -> Iterator[bytes]:
    """Raw bytes from a restart point to the end of the file, through all its members.

    Members read from their header on are checked against their checksum. A broken or cut stream raises.
    """
    size, at = file.size(), start.packed_at
    inflater = zlib.decompressobj(31) if start.window is None else zlib.decompressobj(-15, zdict=start.window)
    trailer = 8 if start.window is not None else 0  # checksum and length that a raw stream leaves behind
    while at < size:
        data = file.read_at(min(READ, size - at), at)
        at += len(data)
        while data:
            if inflater.eof:
                skipped = data[:trailer]
                data, trailer = data[len(skipped) :], trailer - len(skipped)
                if trailer or not data:
                    break
                if not data.strip(b"\0"):  # padding after the last member
                    break
                inflater = zlib.decompressobj(31)
            out = inflater.decompress(data)
            if out:
                yield out
            data = inflater.unused_data if inflater.eof else b""
    if not inflater.eof or trailer:
        raise EOFError("gzip stream breaks off")


def restart_points(uri: str, every: int) -> tuple[int, list[Restart]]:
    """Raw size of a gzip file and restart points at least `every` raw bytes apart, from one pass over it."""
    found = [BEGIN]
    raw = 0
    window = b""
    with open_file(uri) as file:
        size, at = file.size(), 0
        inflater = zlib.decompressobj(31)
        held, held_at = b"", 0  # compressed bytes not yet inflated, and where they begin
        while True:
            if len(held) < READ and at < size:
                data = file.read_at(min(READ, size - at), at)
                at += len(data)
                held += data
            if not held:
                break
            if inflater.eof:
                if not held.strip(b"\0"):
                    held_at, held = held_at + len(held), b""
                    continue
                inflater = zlib.decompressobj(31)
                if raw - found[-1].raw_at >= every:
                    found.append(Restart(held_at, raw, None))
            # Up to the next flush, or all of it; a flush may lie across two reads.
            mark = held.find(FLUSH) if raw - found[-1].raw_at >= every else -1
            cut = mark + len(FLUSH) if mark >= 0 else max(len(held) - len(FLUSH), 0) if at < size else len(held)
            if cut == 0:
                if at >= size:
                    break
                continue
            out = inflater.decompress(held[:cut])
            raw += len(out)
            window = (window + out)[-WINDOW:]
            left = inflater.unused_data if inflater.eof else b""
            held_at, held = held_at + cut - len(left), left + held[cut:]
            if mark >= 0 and not inflater.eof and raw - found[-1].raw_at >= every:
                if _is_flush(inflater, held[:READ], window):
                    found.append(Restart(held_at, raw, window))
        if not inflater.eof:
            raise EOFError(f"gzip stream of {uri} breaks off")
    return raw, found


def _is_flush(inflater, following: bytes, window: bytes) -> bool:
    """Whether the bytes after a flush inflate alike without the state before them: the pattern may be chance."""
    try:
        wanted = inflater.copy().decompress(following, PROOF)
        return bool(wanted) and zlib.decompressobj(-15, zdict=window).decompress(following, PROOF) == wanted
    except zlib.error:
        return False


# Framing -----------------------------------------------------------------------------------------------


@dataclass
class Part(InputPartition):
    """The lines of a file whose first byte lies in [begin, end) of its raw bytes (end None: to the end)."""

    uri: str
    restart: Restart
    begin: int
    end: int | None


def parts_of(uri: str, raw_size: int, restarts: list[Restart], count: int) -> list[Part]:
    """`count` parts of about equal size, each with the last restart point before it."""
    cuts = [raw_size * k // count for k in range(count)] + [None]
    found = []
    for begin, end in zip(cuts[:-1], cuts[1:]):
        if begin != end:
            # The byte before decides whether a line begins here, so it has to be read too, unless a window holds it.
            usable = [r for r in restarts if r.raw_at < begin or (r.raw_at == begin and (begin == 0 or r.window))]
            found.append(Part(uri, usable[-1], begin, end))
    return found


def framed(part: Part, limit: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Blocks of whole lines of a part: bytes, and begin and end of every line that is not empty.

    Lines end at \\n, one \\r before it is not part of the line. A line of `limit` bytes or more raises: such a stream is damaged.
    """
    position = part.restart.raw_at
    before = (part.restart.window or b"\n")[-1:]  # the byte before what is read next
    held: list[bytes] = []
    size = 0
    started = False
    done = False

    def block(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10)
        if len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
            ends = np.append(ends, len(raw))
        begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        if len(ends) and int((ends - begins).max()) >= limit:
            raise ValueError(f"{part.uri}: line longer than {limit} bytes")
        returned = (ends > begins) & (raw[np.maximum(ends - 1, 0)] == 13)
        ends = ends - returned
        kept = ends > begins
        return data, begins[kept], ends[kept]

    with open_file(part.uri) as file:
        for data in inflate(file, part.restart):
            at, position = position, position + len(data)
            if not started:
                if position <= part.begin:
                    before = data[-1:]
                    continue
                skip = part.begin - at
                if skip > 0:
                    before, data, at = data[skip - 1 : skip], data[skip:], part.begin
                if part.begin and before != b"\n":  # the line belongs to the part before
                    line_end = data.find(b"\n")
                    if line_end < 0 or (part.end is not None and at + line_end + 1 >= part.end):
                        if part.end is not None and position >= part.end:
                            return  # no line begins in this part
                        before = b"x"
                        part = Part(part.uri, part.restart, position, part.end)
                        continue
                    data, at = data[line_end + 1 :], at + line_end + 1
                started = True
            if part.end is not None and position >= part.end:
                # The last line of the part ends at the first line break at or after its last byte.
                line_end = data.find(b"\n", max(part.end - 1 - at, 0))
                if line_end >= 0:
                    data, done = data[: line_end + 1], True
            held.append(data)
            size += len(data)
            if done:
                break
            if size >= BATCH:
                whole = b"".join(held)
                last = whole.rfind(b"\n") + 1
                if last:
                    yield block(whole[:last])
                elif size > limit:
                    raise ValueError(f"{part.uri}: line longer than {limit} bytes")
                held, size = [whole[last:]], len(whole) - last
    if size:
        yield block(b"".join(held))


# What a line holds ----------------------------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_DEPTH = np.zeros(256, np.int32)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in '"{}[],:']] = True
_TURNS = 32


def _past_blanks(raw: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """Walk from `at` towards `stop` (not included) to the first byte that is no blank; `stop` if there is none."""
    at = at.copy()
    rows = np.flatnonzero(at != stop)
    for turn in range(1 << 62):
        rows = rows[_BLANK[raw[at[rows]]]]
        if not len(rows):
            break
        if turn == _TURNS:  # a few very long runs of blanks
            for row in rows.tolist():
                part = raw[at[row] : stop[row]] if step > 0 else raw[stop[row] + 1 : at[row] + 1][::-1]
                solid = np.flatnonzero(~_BLANK[part])
                at[row] = at[row] + step * int(solid[0]) if len(solid) else stop[row]
            break
        at[rows] += step
        rows = rows[at[rows] != stop[rows]]
    return at


def _unescaped(raw: np.ndarray, marks: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """False for quotes behind an odd run of backslashes."""
    plain = np.ones(len(marks), bool)
    rows = np.flatnonzero((kind == 34) & (marks > 0))
    rows = rows[raw[marks[rows] - 1] == 92]
    back = marks[rows] - 1
    while len(rows):  # as many turns as the longest run of backslashes
        plain[rows] ^= True
        more = (back > 0) & (raw[back - 1] == 92)
        rows, back = rows[more], back[more] - 1
    return plain


def member_spans(data: bytes, begins: np.ndarray, ends: np.ndarray, member: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line: does it hold one object and nothing else, and begin and end of that member's value (-1: no member).

    Works on the marks of all lines of a block at once; `begins` and `ends` are those of the lines that are not empty. A line
    that is no JSON inside its braces may pass here; the JSON parser sees that. Of several members with the name the
    last one counts, as in the parser.
    """
    raw, lines = np.frombuffer(data, np.uint8), len(begins)
    whole, begin, end = np.zeros(lines, bool), np.full(lines, -1, np.int64), np.full(lines, -1, np.int64)
    marks = np.flatnonzero(_MARKS[raw])
    kind = raw[marks]
    plain = _unescaped(raw, marks, kind)
    marks, kind = marks[plain], kind[plain]
    if not len(marks):
        return whole, begin, end
    quote = kind == 34
    quotes = np.cumsum(quote, dtype=np.int32)

    def per_line(running: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A running total that starts anew in each line."""
        before = np.where(firsts > 0, running[np.maximum(firsts - 1, 0)], 0)
        return running - np.repeat(before, counts)

    firsts = np.searchsorted(marks, begins)
    counts = np.diff(np.append(firsts, len(marks)))
    outside = (per_line(quotes, firsts, counts) & 1) == 0  # also true for closing quotes
    opening = marks[quote & ~outside]
    used = outside & ~quote
    marks, kind = marks[used], kind[used]
    if not len(marks):
        return whole, begin, end
    firsts = np.searchsorted(marks, begins)
    counts = np.diff(np.append(firsts, len(marks)))
    step = _DEPTH[kind]
    depth = per_line(np.cumsum(step, dtype=np.int32), firsts, counts)  # after the mark

    # The object is whole if the line begins with a brace and the first mark at depth 0 ends the line.
    first = _past_blanks(raw, begins, ends, 1)
    last = _past_blanks(raw, ends - 1, begins - 1, -1)
    closes = np.flatnonzero((depth == 0) & (step == -1))
    close = np.searchsorted(closes, firsts)
    found = (close < len(closes)) & (first < ends)
    rows = np.flatnonzero(found)
    rows = rows[raw[first[rows]] == ord("{")]
    whole[rows] = marks[closes[close[rows]]] == last[rows]

    # Names: strings at depth 1 that are followed by a colon.
    name = f'"{member}"'.encode()
    named = np.array([m.start() for m in re.finditer(re.escape(name), data)], np.int64)
    place = np.searchsorted(opening, named)
    named = named[(place < len(opening)) & (opening[np.minimum(place, len(opening) - 1)] == named)] if len(opening) else named[:0]
    line = np.searchsorted(begins, named, "right") - 1
    colon = np.searchsorted(marks, named)
    good = (colon < firsts[line] + counts[line]) & (colon > firsts[line])
    named, line, colon = named[good], line[good], colon[good]
    good = (kind[colon] == ord(":")) & (depth[colon - 1] == 1)
    good &= _past_blanks(raw, named + len(name), marks[colon], 1) == marks[colon]
    line, colon = line[good], colon[good]
    stops = np.flatnonzero(((kind == ord(",")) & (depth == 1)) | ((depth == 0) & (step == -1)))
    place = np.searchsorted(stops, colon)
    good = place < len(stops)
    line, colon, stop = line[good], colon[good], stops[place[good]]
    good = stop < firsts[line] + counts[line]
    line, colon, stop = line[good], marks[colon[good]], marks[stop[good]]
    # Assignments run in order, so the last member of a name wins.
    begin[line] = _past_blanks(raw, colon + 1, stop, 1)
    end[line] = _past_blanks(raw, stop - 1, colon, -1) + 1
    begin[end <= begin] = -1
    return whole, begin, end


# The data source --------------------------------------------------------------------------------------------

LINES = "file string, line binary, whole boolean, member binary"
_LINES = pa.schema([("file", pa.string()), ("line", pa.binary()), ("whole", pa.bool_()), ("member", pa.binary())])


def _pieces(data: bytes, begins: np.ndarray, ends: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Slices of `data` as an Arrow column, without a Python object per line."""
    lengths = np.where(missing, 0, ends - begins) if missing is not None else ends - begins
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    raw = np.frombuffer(data, np.uint8)
    used = ~missing if missing is not None else slice(None)
    step = np.zeros(len(raw) + 1, np.int8)
    step[begins[used]] += 1
    step[ends[used]] -= 1
    content = raw[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    mask = pa.array(~missing).buffers()[1] if missing is not None else None
    return pa.Array.from_buffers(pa.binary(), len(begins), [mask, pa.py_buffer(offsets), pa.py_buffer(content)])


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], member: str, limit: int, index: str | None):
        self.files, self.member, self.limit, self.index = files, member, limit, index

    def partitions(self) -> list[Part]:
        parts: dict[str, list[Part]] = {}
        if self.index:
            with open_file(self.index) as file:
                for row in json.loads(file.read().decode()):
                    restarts = [Restart(a, b, bytes.fromhex(w) if w is not None else None) for a, b, w in row["restarts"]]
                    parts[row["file"]] = parts_of(row["file"], row["raw_size"], restarts, row["parts"])
        self._check_files()
        return [part for file in self.files for part in parts.get(file, [Part(file, BEGIN, 0, None)])]

    def _check_files(self) -> None:
        """A missing file fails the query before its first task; all files are asked for at once."""
        if self.files:
            system = _system(self.files[0])[0]
            for info in system.get_file_info([_system(file)[1] for file in self.files]):
                if info.type != fs.FileType.File:
                    raise FileNotFoundError(info.path)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        name = part.uri.rpartition("/")[2]
        for data, begins, ends in framed(part, self.limit):
            if not len(begins):
                continue
            whole, begin, end = member_spans(data, begins, ends, self.member)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(begins), np.int32)), pa.array([name])).cast(pa.string()),
                    _pieces(data, begins, ends),
                    pa.array(whole),
                    _pieces(data, begin, end, begin < 0),
                ],
                schema=_LINES,
            )


class GzipLines(DataSource):
    """`spark.read.format("gzip_lines")`: JSON lines of gzip files with the exact text of one member.

    Options: `files` (JSON list of paths or URIs), `member`, `limit` (bytes), `index` (file that `index_files` wrote; without it a
    file is one task). Files are opened by the tasks through Arrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(json.loads(o["files"]), o["member"], int(o["limit"]), o.get("index"))


def read_gzip_lines(spark: SparkSession, files: list[str], member: str, limit: int, index: str | None = None) -> DataFrame:
    spark.dataSource.register(GzipLines)
    reader = spark.read.format("gzip_lines").option("files", json.dumps(files)).option("member", member).option("limit", limit)
    return (reader.option("index", index) if index else reader).load()


def index_files(spark: SparkSession, files: list[str], parts: int, every: int = 1 << 25) -> DataFrame:
    """(file, raw_size, restarts) of every file, one task each. `every`: raw bytes between two restart points.

    Reads the files once without parsing; checksums are verified on the way.
    """

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                raw, found = restart_points(uri, every)
                held = json.dumps([[r.packed_at, r.raw_at, r.window.hex() if r.window is not None else None] for r in found])
                yield pa.RecordBatch.from_pydict({"file": [uri], "raw_size": [raw], "restarts": [held]})

    rows = spark.createDataFrame([(f,) for f in files], "file string").repartitionByRange(len(files), "file")
    return rows.mapInArrow(points, "file string, raw_size long, restarts string")
