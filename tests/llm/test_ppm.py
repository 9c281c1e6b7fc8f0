import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import ppm
from tidemark.llm.ppm import score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows):
    tokens = [[w.encode() for w in WORD.findall((t or "").translate(UPPER))] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    counts = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    ends = held.count(False)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for (doc, _), ts, h, (_, score) in zip(rows, tokens, held, plain_contexts(rows, ppm.ORDER)):
        cs = [*(counts[t] for t in ts), ends]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs)
        out.append((doc, h, len(ts) + 1, sum(c > 0 for c in cs), n, base, score))
    return sorted(out, key=repr)


ROWS = [(i, f"The cat {i % 7} sat on\tthe MAT {'x' * (i % 4)} ÉÀ é\n" * (i % 3 + 1) + f"rare{i}") for i in range(60)]
ROWS += [(None, "null id"), (None, None), (61, ""), (62, None), (3, "again"), (3, "again"), (70, "q" * 5000 + " \x00\x01 zz" * 200)]


@pytest.mark.parametrize("heavy", [1 << 20, 50, 1])
def test_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(ppm, "HEAVY", heavy)
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id BIGINT, text STRING, score INT").repartition(3)
    got = sorted(map(tuple, score_texts(docs).collect()), key=repr)
    want = plain(ROWS)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_nothing_to_learn_from(spark):
    only_held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    rows = [(only_held, "a bc"), (only_held, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = sorted(map(tuple, score_texts(docs).collect()), key=repr)
    for g, w in zip(got, plain(rows)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6], rel=1e-9)
    assert score_texts(docs.limit(0)).collect() == []


def plain_contexts(rows, order):
    """Whole texts as symbols, every order counted from every learned symbol, escape by method C with exclusion."""
    texts = [[*b" ".join(w.encode() for w in WORD.findall((t or "").translate(UPPER))), 256] for _, t in rows]
    counts = {}
    for (doc, _), symbols in zip(rows, texts):
        past = [None] * (order - 1) + ["begin", *symbols]
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 != 1:
            for i, s in enumerate(symbols):
                for k in range(order + 1):
                    counts.setdefault(tuple(past[i + order - k : i + order]), Counter())[s] += 1
    out = []
    for (doc, _), symbols in zip(rows, texts):
        past, total = [None] * (order - 1) + ["begin", *symbols], 0.0
        for i, s in enumerate(symbols):
            excluded = set()
            for k in range(order, -1, -1):
                seen = counts.get(tuple(past[i + order - k : i + order]), {})
                found = {x: n for x, n in seen.items() if x not in excluded}
                if not found:
                    continue
                room = sum(found.values()) + len(found)
                if s in found:
                    total += math.log10(found[s] / room)
                    break
                total += math.log10(len(found) / room)
                excluded |= set(found)
            else:
                total -= math.log10(257 - len(excluded))
        out.append((repr(doc), total))
    return out


@pytest.mark.parametrize("hot", [1 << 21, 50, 0])
def test_contexts_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT_CELLS", hot)
    for rows in (ROWS, [(d, t) for d, t in ROWS if zlib.crc32(str(d).encode()) % 5 == 1 and d is not None]):
        docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
        got = sorted((repr(r.doc_id), r.score) for r in score_texts(docs).collect())
        want = sorted(plain_contexts(rows, ppm.ORDER))
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9)


def test_order_of_known_words_counts(spark):
    learned = [d for d in range(200) if zlib.crc32(str(d).encode()) % 5 != 1]
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1][:2]
    fluent, shuffled = "the old cat sat on the red mat", "mat red the on sat cat old the"
    rows = [(d, fluent) for d in learned] + [(held[0], fluent), (held[1], shuffled)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got[held[0]].n_known == got[held[1]].n_known == 9
    assert got[held[0]].score > got[held[1]].score + 5


def test_pieces_of_a_text_join_up(monkeypatch):
    tokens = [b"the", b"cat", b"\xc3\xa9t", b"x" * 40]
    whole = [c.tolist() for c in ppm.text_cells(tokens)]
    monkeypatch.setattr(ppm, "PIECE", 7)
    pieces = [c.tolist() for c in ppm.text_cells(tokens)]
    assert len(whole) == 1 and len(pieces) > 1 and sum(pieces, []) == whole[0]
