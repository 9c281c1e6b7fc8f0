"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of one Arrow column.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Bytes of an Arrow column are looked at in pieces of bounded size
that end between words, so the temporary arrays do not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
CHUNK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(base: int, length: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < length:
        held = np.full(max(length, 2 * PIECE), base, np.uint64)
        held[0] = 1
        _powers[base] = np.multiply.accumulate(held)
    return _powers[base][:length]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from one running sum of byte * base^position."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=sums[1:])
    raw = (sums[end] - sums[start]) * _power_table(_INVERSE, n + 1)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


@dataclass
class Spans:
    """Byte ranges with the text each one is in, a hash of their bytes and their number of code points."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    chars: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[pa.Array]:
    """Consecutive rows of about `limit` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > limit:
            yield column.slice(first, row - first)
            first, held = row, 0
        held += size
    if len(column) > first:
        yield column.slice(first)


def _cuts(breaks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end at a break; `breaks` are sorted positions."""
    at = 0
    while at < size:
        k = np.searchsorted(breaks, at + PIECE)
        to = int(breaks[k]) if k < len(breaks) else size
        yield at, max(to, at + 1)
        at = max(to, at + 1)


def spans_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, lower: bool = False) -> Spans:
    """Maximal runs without a separator byte inside each text."""
    size = len(data)
    inside = ~separator[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.ones(size, bool)
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:size]))
    after = np.ones(size, bool)
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return _measured(data, offsets, start, end, lower)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Spans:
    r"""The \n-split lines of each text, empty ones included."""
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    start.sort()
    end.sort()
    spans = _measured(data, offsets, start, end, False)
    spans.text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(breaks, offsets)) + 1)
    return spans


def _measured(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> Spans:
    hashes = np.zeros(len(start), np.uint64)
    chars = np.zeros(len(start), np.int64)
    first = 0
    for a, b in _cuts(end, len(data)):
        last = int(np.searchsorted(end, b, "right"))
        if last > first:
            a = int(start[first])
            part = data[a:b]
            if lower:
                part = LOWER[part]
            s, e = start[first:last] - a, end[first:last] - a
            hashes[first:last] = span_hashes(part, s, e)
            points = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=points[1:])
            chars[first:last] = points[e] - points[s]
        first = last
    text = np.searchsorted(offsets, start, "right") - 1
    return Spans(start, end, text, hashes, chars)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Spans:
    return spans_of(data, offsets, SPACE, lower)


# Odd multipliers that keep the order of the words in a window apart.
_TURNS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(spans: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of `n` consecutive words of one text, from the hash of the n - 1 before."""
    count = len(spans) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total += spans.hash[k : k + count] * _TURNS[k]
    first = np.flatnonzero(spans.text[:count] == spans.text[n - 1 :])
    return first, mix(total[first])
