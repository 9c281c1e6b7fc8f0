"""Run-length repair against a plain search over whole audits."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import SF

from tidemark.llm import conversations as cv
from tidemark.llm.queries import QUERIES

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    found = {}
    for conv, turn, role, text in rows:
        here = found.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(rs, key=order) for c, rs in found.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        if not BLANK.search(text):
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            found.append("truncated")
        else:
            found.append("")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Uniform-cost search over (rows done, pattern state), smallest (cost, audit) first."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, closed = [(0, "", 0, "", [])], set()
    while queue:
        cost, audit, at, state, out = heapq.heappop(queue)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (at, state) in closed:
            continue
        closed.add((at, state))
        new = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(queue, (cost + 2, audit + "I", at, new, out + [f"{name}:"]))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, out))
            if found[at] in ("", "truncated"):
                extra = found[at] == "truncated"
                if role[:1] and role[:1] in steps[state]:
                    heapq.heappush(queue, (cost + extra, audit + "K", at + 1, role[0], out + [f"{role}:{text}"]))
                heapq.heappush(queue, (cost + 2 + extra, audit + "R", at + 1, new, out + [f"{name}:{text}"]))
    raise AssertionError


def expected(rows):
    for conv, own in damaged(rows).items():
        found = faults(own)
        cost, audit, out = cheapest(own, found)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
        yield (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def ours(frame):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert frame.columns == columns
    return sorted((tuple(r) for r in frame.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def messy(rng, conversations, most=12):
    rows = []
    for c in range(conversations):
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "sys"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "", None, " \n", "Well. ", "é", f"Number {rng.randrange(9)}.", "end. "])
            rows.append((c, rng.choice([turn, turn, turn * 2, None, -turn]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_search(spark, seed):
    rows = messy(random.Random(seed), 120)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")] + [(500, 3, "user", "Same.")] * 9
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS kind", "'x' AS digest", "2 AS copies").repartition(5)
    assert ours(cv.damage_and_repair(frame)) == sorted(expected(rows), key=repr)


def test_long_conversations_in_many_segments(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, t, "user" if t % 2 else "assistant", f"Line {t}.") for t in range(9000)]
    rows += [(2, t, "user", f"Line {t // 3}.") for t in range(4600)]
    rows += [(3, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", f"b {t}", f"c {t}."])) for t in range(4500)]
    rows += [(4, 4, "user", "Copy.")] * 6000
    assert ours(cv.damage_and_repair(spark.createDataFrame(rows, SCHEMA).repartition(4))) == sorted(expected(rows), key=repr)


def test_segments_do_not_matter():
    rng = random.Random(3)
    for _ in range(200):
        symbols = "".join(rng.choice("suaxSUAX-") * rng.choice([1, 1, 2, 7]) for _ in range(rng.randrange(1, 12))).encode()
        whole = cv.segment_matrix(symbols)
        cut = rng.randrange(len(symbols) + 1)
        parts = [cv.segment_matrix(p) for p in (symbols[:cut], symbols[cut:]) if p]
        joined = parts[0] if len(parts) == 1 else cv.product(*parts)
        slow = cv.row_matrix(symbols[0])
        for s in symbols[1:]:
            slow = cv.product(slow, cv.row_matrix(s))
        assert np.array_equal(whole, slow) and np.array_equal(whole, joined)
        rest = tuple(cv.ahead(parts[1], np.array(cv.END)).tolist()) if len(parts) == 2 else cv.END
        first, state = cv.unroll(symbols[:cut] or symbols, 0, rest if len(parts) == 2 else cv.END)
        if len(parts) == 2:
            second, state = cv.unroll(symbols[cut:], state, cv.END)
            first = first + second
        assert (first, state) == cv.unroll(symbols, 0, cv.END)


def test_long_runs_take_powers():
    cv._squares.clear()
    for n in (1, 2, 3, 1000, 10**12):
        assert cv.run_matrix(ord("u"), n)[cv.START, cv.USER] <= 3 * n
    assert len(cv._squares) <= 41


def test_dropped_and_empty(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(7, dropped, "user", "Hi.")], SCHEMA)
    assert ours(cv.damage_and_repair(frame)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.damage_and_repair(frame.limit(0)).count() == 0


def test_very_long_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "word " * 200_000 + ".") for t in range(4)]
    assert ours(cv.damage_and_repair(spark.createDataFrame(rows, SCHEMA))) == sorted(expected(rows), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ours(QUERIES["op13_run_length_repair"](spark, SF)) == sorted(expected(rows), key=repr)
