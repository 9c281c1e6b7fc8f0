"""Quality rules on repetition: how much of a text stands inside repeated word windows and repeated lines.

Window hashes of several lengths are rolled over the word hashes of a whole Arrow batch in numpy; equal windows of one
text meet by sorting (text, hash). Nothing is shuffled: a text is judged from itself alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import unused
from tidemark.llm.memory import give_back
from tidemark.llm.text import Spans, buffers_of, lines_of, mix, slices, windows, words_of
from tidemark.llm.words_cache import release_caches

# Published thresholds of the repetition rules for web text. A text passes up to and including them.
# Top windows count all their places; duplicated windows and lines count those after the first.
MOST_DUPLICATE_LINES = 0.30
MOST_DUPLICATE_LINE_CHARS = 0.20
MOST_TOP_CHARS = {2: 0.20, 3: 0.18, 4: 0.16}
MOST_DUPLICATE_CHARS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

# The base rule. Words needed, window length, and percent of words in repeated windows.
FEWEST_WORDS = 10
BASE_WINDOW = 5
MOST_REPEAT_PERCENT = 20

SLICE = 1 << 19  # bytes of text judged at a time

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [
    "dup_line_share",
    "dup_line_char_share",
    *[f"top_{n}gram_char_share" for n in MOST_TOP_CHARS],
    *[f"dup_{n}gram_char_share" for n in MOST_DUPLICATE_CHARS],
]
RESULT = ", ".join(
    [*[f"{c} BIGINT" for c in COUNTS], *[f"{s} DOUBLE" for s in SHARES], "base_failed BOOLEAN", "kept BOOLEAN"]
)
_ARROW = pa.struct(
    [*[(c, pa.int64()) for c in COUNTS], *[(s, pa.float64()) for s in SHARES]]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def _runs(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that puts equal (text, hash) together, the start of each run in it and the length of each run."""
    keys = hashes ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(keys)))


def _covered(words: Spans, first: np.ndarray, n: int, repeated: np.ndarray) -> np.ndarray:
    """Words inside at least one repeated window."""
    change = np.zeros(len(words) + 1, np.int64)
    change[first[repeated]] += 1
    np.subtract.at(change, first[repeated] + n, 1)
    return np.cumsum(change[:-1]) > 0


def _per_text(text: np.ndarray, weight: np.ndarray | None, count: int) -> np.ndarray:
    return np.bincount(text, weight, count).astype(np.int64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def profile(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and shares of every text of one column."""
    data, offsets = buffers_of(column)
    count = len(column)
    words = words_of(data, offsets)
    out: dict[str, np.ndarray] = {"n_words": _per_text(words.text, None, count)}
    out["word_chars"] = word_chars = _per_text(words.text, words.chars, count)
    marks = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = _per_text(np.searchsorted(offsets, marks, "right") - 1, None, count)

    lines = lines_of(data, offsets)
    if len(words):  # lines with a word
        at = np.searchsorted(words.start, lines.start)
        used = (at < len(words)) & (words.start[np.minimum(at, len(words) - 1)] < lines.end)
    else:
        used = np.zeros(len(lines), bool)
    text, chars = lines.text[used], lines.chars[used]
    order, starts, lengths = _runs(text, lines.hash[used])
    firsts = np.minimum.reduceat(order, starts) if len(starts) else starts  # the earliest line of each run
    again = np.ones(len(text), bool)
    again[firsts] = False
    out["n_dup_lines"] = _per_text(text[again], None, count)
    out["dup_line_share"] = _share(out["n_dup_lines"], _per_text(text, None, count))
    out["dup_line_char_share"] = _share(_per_text(text[again], chars[again], count), _per_text(text, chars, count))

    upto = np.concatenate([[0], np.cumsum(words.chars)])
    for n in sorted({BASE_WINDOW, *MOST_TOP_CHARS, *MOST_DUPLICATE_CHARS}):
        first, hashes = windows(words, n)
        text = words.text[first]
        order, starts, lengths = _runs(text, hashes)
        if n in MOST_TOP_CHARS:
            head = order[starts]
            size = np.where(lengths > 1, lengths * (upto[first[head] + n] - upto[first[head]]), 0)
            top = np.zeros(count, np.int64)
            np.maximum.at(top, text[head], size)
            out[f"top_{n}gram_char_share"] = _share(top, word_chars)
        if n == BASE_WINDOW or n in MOST_DUPLICATE_CHARS:
            repeated = np.zeros(len(first), bool)
            repeated[order] = np.repeat(lengths > 1, lengths)
            if n == BASE_WINDOW:
                inside = _covered(words, first, n, repeated)
                out["n_repeat_words"] = _per_text(words.text[inside], None, count)
            if n in MOST_DUPLICATE_CHARS:
                if len(starts):
                    repeated[np.minimum.reduceat(order, starts)] = False  # a window's first place is no repetition
                inside = _covered(words, first, n, repeated)
                chars = _per_text(words.text[inside], words.chars[inside], count)
                out[f"dup_{n}gram_char_share"] = _share(chars, word_chars)

    out["base_failed"] = (out["n_words"] < FEWEST_WORDS) | (
        100 * out["n_repeat_words"] > MOST_REPEAT_PERCENT * out["n_words"]
    )
    passed = (out["dup_line_share"] <= MOST_DUPLICATE_LINES) & (out["dup_line_char_share"] <= MOST_DUPLICATE_LINE_CHARS)
    for n, most in MOST_TOP_CHARS.items():
        passed &= out[f"top_{n}gram_char_share"] <= most
    for n, most in MOST_DUPLICATE_CHARS.items():
        passed &= out[f"dup_{n}gram_char_share"] <= most
    out["kept"] = passed & ~out["base_failed"]
    return out


def _profiles(column: pa.Array) -> pa.Array:
    release_caches()
    parts = [profile(part) for part in slices(column, SLICE)] or [profile(column)]
    give_back()
    arrays = [pa.array(np.concatenate([p[f.name] for p in parts]), f.type) for f in _ARROW]
    return pa.StructArray.from_arrays(arrays, fields=list(_ARROW))


def with_repetition(docs: DataFrame, text: str = "text", out: str = "repetition") -> DataFrame:
    """Add a struct with the counts, shares and verdict of each text; all rows and other columns stay as they are.

    A null or empty text has zero counts and shares and fails the base rule (fewer than 10 words), as does one of
    white space only. Texts are read whole whatever their length. Repeated rows are judged alike. A column that has
    the name `out` is replaced; an empty table gives no rows.
    """
    judge = F.arrow_udf(_profiles, RESULT)
    return docs.withColumn(out, judge(F.col(text)))


def keep_unrepetitive(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with the columns they came with."""
    (out,) = unused(docs, "repetition")
    judged = with_repetition(docs, text, out)
    return judged.filter(F.col(f"{out}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
