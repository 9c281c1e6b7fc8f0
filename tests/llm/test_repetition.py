import re

import pyarrow as pa
import pytest

from tidemark.llm.repetition import COUNTS, MOST_DUPLICATE_CHARS, MOST_TOP_CHARS, keep_unrepetitive, profile, with_repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, again, chars = set(), 0, 0
    for line in lines:
        if line in seen:
            again += 1
            chars += len(line)
        seen.add(line)
    out["n_dup_lines"] = again
    out["dup_line_share"] = again / len(lines) if lines else 0
    out["dup_line_char_share"] = chars / sum(map(len, lines)) if lines else 0

    def grams(n):
        found = {}
        for i in range(len(words) - n + 1):
            found.setdefault(tuple(words[i : i + n]), []).append(i)
        return found

    def inside(n, skip=0):
        return {i + k for at in grams(n).values() if len(at) > 1 for i in at[skip:] for k in range(n)}

    total = out["word_chars"]
    out["n_repeat_words"] = len(inside(5))
    for n in MOST_TOP_CHARS:
        top = max((len(at) * sum(map(len, g)) for g, at in grams(n).items() if len(at) > 1), default=0)
        out[f"top_{n}gram_char_share"] = top / total if total else 0
    for n in MOST_DUPLICATE_CHARS:
        out[f"dup_{n}gram_char_share"] = sum(len(words[i]) for i in inside(n, 1)) / total if total else 0
    return out


LONG = " ".join(f"w{i * 7919 % 1009}é" for i in range(60_000)) + " " + "x" * 1_500_000 + "\nend\nend"
TEXTS = [
    None, "", " \t\n ", "one", "a b\na b\n\na b\n", "ein zwei drei vier fünf\x85sechs sieben acht neun zehn elf",
    "x y z " * 50, "line one\n" * 4 + "tail", "# a | b > c\n\n\n$%", LONG, LONG[: 700_000], "the end\n",
    "the quick brown fox jumps over the lazy dog and runs far away from all the noise of the city\n",
    "\n", "a b c d e a b c d e", "a b c d e f a b c d e",
]


def test_profile_equals_brute_force():
    got = profile(pa.array(TEXTS, pa.string()))
    for row, text in enumerate(TEXTS):
        for name, value in plain(text).items():
            assert got[name][row] == pytest.approx(value), (name, row)


def test_rows_and_columns_stay(spark):
    docs = spark.createDataFrame(
        [(1, TEXTS[-4], 5), (1, TEXTS[-4], 5), (None, None, 6), (2, "", None), (3, "x y z " * 50, 1)],
        "doc_id BIGINT, text STRING, kept INT",
    )
    rows = with_repetition(docs).collect()
    assert len(rows) == 5 and [r.repetition.kept for r in rows] == [True, True, False, False, False]
    assert with_repetition(docs.limit(0)).collect() == []
    kept = keep_unrepetitive(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    assert set(COUNTS) <= set(rows[0].repetition.asDict())


def test_a_column_of_the_same_name_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5), (2, "few", 6)], "doc_id INT, text STRING, __repetition INT")
    assert [tuple(r) for r in keep_unrepetitive(docs).collect()] == [(1, text, 5)]
