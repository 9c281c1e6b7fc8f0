"""The lattice audit against filters that run one after the other, and against its SQL."""

import re
from itertools import permutations
from math import factorial

import pytest
from llm_helpers import SF, same_rows
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.filter_audit import COUNTS, audit_filters, audit_masks, paths, text_failures
from tidemark.llm.queries import QUERIES


def brute(docs, names):
    """docs: (part, failed letters, n, good, toxic)."""
    found = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shares = dict.fromkeys(names, 0)
        for order in permutations(names):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                failing = sum(d[2] for d in mine if letter in d[1])
                left = [d for d in left if letter not in d[1]]
                removed = sum(d[2] for d in gone)
                shares[letter] += removed
                found[part, "".join(order), step] = [
                    sum(d[2] for d in left), removed, failing - removed, sum(d[2] for d in mine if d[1] == {letter}),
                    sum(d[2] * d[3] for d in gone), sum(d[2] * d[4] for d in gone),
                ]
        for (p, order, step), values in found.items():
            if p == part:
                values.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def audited(frame):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*COUNTS, "shapley")) for r in frame.collect()}


def test_path_counts():
    for n in (1, 3, 5):
        forward, backward = paths(n)
        for state in range(1 << n):
            size = state.bit_count()
            assert forward[state] == factorial(size) and backward[state] == factorial(n - size)


@pytest.mark.parametrize("names", ["A", "XYZ", "ABCD"])
def test_masks_against_single_orders(spark, names):
    full = 1 << len(names)
    rows = [("p" if m % 3 else "q", m, 3 + m * 7 % 5, m % 4, m % 2) for m in range(full)] * 2
    counts = spark.createDataFrame(rows, "part string, mask int, docs long, good long, toxic long")
    docs = [(part, {names[i] for i in range(len(names)) if mask >> i & 1}, n, 0, 0) for part, mask, n, _, _ in rows]
    ours, expected = audited(audit_masks(counts, names)), brute(docs, names)
    assert set(ours) == set(expected)
    for key, values in expected.items():
        assert ours[key][:4] == values[:4] and ours[key][6] == values[6]
    failing = {p: sum(r[2] for r in rows if r[0] == p and r[1]) for p in ("p", "q")}
    for part, n in failing.items():
        shares = {order[step - 1]: values[6] for (p, order, step), values in ours.items() if p == part}
        assert sum(shares.values()) == n * factorial(len(names))


def test_too_many_or_equal_names(spark):
    counts = spark.createDataFrame([], "part string, mask int, docs long, good long, toxic long")
    for names in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            audit_masks(counts, names)
    assert audit_masks(counts, "AB").count() == 0


LONG = " ".join(f"word{i}" for i in range(150))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG + " $", "de"), (4, None, "en"), (5, "", None), (6, "a " * 200, ""),
    (7, "SHOUT " * 120, "en"), (8, "SHOUT " * 120, "de"), (9, "\t\n", "en"), (9, "\t\n", "en"), (10, "few words #", "en"),
    (None, LONG, "en"), (11, LONG.replace(" ", " "), "fr"), (12, "É" * 50 + " A", "fr"), (9, "\t\n", "de"), (13, " ".join([LONG] * 400), "es"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (7, 0, 1), (8, 1, None), (9, 1, 0), (None, 1, 1), (99, 1, 1)]


def judged():
    for doc_id, text, lang in ROWS:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        failed = set()
        if len(words) < 100:
            failed.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            failed.add("C")
        if set(t) & set("#$%&*|"):
            failed.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (o or "") == t for i, o, _ in ROWS):
            failed.add("E")
        good = any(i == doc_id and q == 1 for i, q, _ in LABELS if i is not None)
        toxic = any(i == doc_id and x == 1 for i, _, x in LABELS if i is not None)
        yield lang or "", failed, 1, int(good), int(toxic)


def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    docs = docs.withColumn("part", F.lit("x")).withColumn("mask", F.lit(7)).withColumn("id", F.lit(0)).repartition(3)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    docs, labels = tables(spark)
    assert audited(audit_filters(docs, text_failures(), "E", labels)) == brute(list(judged()), "ABCDE")
    without = brute([(p, f, n, 0, 0) for p, f, n, _, _ in judged()], "ABCDE")
    assert audited(audit_filters(docs, text_failures(), "E")) == without
    assert audit_filters(docs.limit(0), text_failures(), "E", labels).count() == 0
    assert audited(audit_filters(docs, text_failures(), "E", labels.limit(0))) == without


def test_query_matches_its_sql(spark, reference):
    frame = QUERIES["op12_filter_audit"](spark, SF)
    same_rows(frame, reference, sql.FILTER_AUDIT)
    assert frame.groupBy("part").count().filter("count <> 600").count() == 0
