"""How filters that run one after the other interact: what each removes in every order, and its Shapley share.

A state is the set of filters that have run; the edge (state, filter) is the step that runs one more. What an edge
removes depends on the state alone and not on the order in which it was reached, so n filters have n! orders but only
n * 2^(n-1) edges. Counting paths forward (orders that reach a state) and backward (orders that leave the next one)
says how many orders use an edge: that is its weight in the Shapley sum. The steps of single orders are read from the
same edges.

Documents enter as counts per part and set of failed filters (at most 2^n rows a part), so nothing after the first
grouping grows with the corpus but the number of parts.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def paths(n: int) -> tuple[list[int], list[int]]:
    """For every set of n filters (a bit mask): orders that reach it from the empty set, and that lead on to the full one."""
    full = (1 << n) - 1
    forward = [1] + [0] * full
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    backward = [0] * full + [1]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def _edges(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders that use the edge)."""
    forward, backward = paths(n)
    return [
        (state, f, forward[state] * backward[state | 1 << f])
        for state in range(1 << n)
        for f in range(n)
        if not state >> f & 1
    ]


def _steps(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, state before it, bit of its filter)."""
    found = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            found.append(("".join(names[i] for i in order), step, state, 1 << f))
            state |= 1 << f
    return found


def audit_masks(counts: DataFrame, names: str) -> DataFrame:
    """The audit of documents that are counted already.

    `counts` has the columns part (string, no null), mask (which filters fail, first name lowest bit), docs, good and
    toxic (longs); several rows of one part and mask add up. `names` has one letter per filter, at most eight of them.
    Returns part, filter_order, step, COUNTS and shapley for every part, order and step, zeros included; no rows for no
    rows. shapley is summed over all orders, so the filters' shares add up to n! times the documents that fail anything.
    """
    n = len(names)
    if len(set(names)) != n or not 1 <= n <= 8:
        raise ValueError("one to eight filters with different letters")
    spark = counts.sparkSession
    masks = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])
    edges = [
        F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("orders"))
        for s, f, w in _edges(n)
    ]
    each = masks.select("*", F.inline(F.array(*edges)))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    passed = F.col("mask").bitwiseAND(F.col("state")) == 0

    def total(condition: Column, what: str) -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(0))

    measured = each.groupBy("part", "state", "bit", "orders").agg(
        total(passed & ~fails, "docs").alias("kept"),
        total(passed & fails, "docs").alias("removed"),
        total(~passed & fails, "docs").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "docs").alias("unique_fails"),
        total(passed & fails, "good").alias("good_lost"),
        total(passed & fails, "toxic").alias("toxic_lost"),
    )
    shares = measured.groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = spark.createDataFrame(_steps(names), "filter_order string, step int, state int, bit int")
    return (
        measured.join(steps, ["state", "bit"])
        .join(shares, ["part", "bit"])
        .select("part", "filter_order", "step", *COUNTS, "shapley")
    )


def audit_filters(
    docs: DataFrame,
    failures: Mapping[str, Column],
    repeated: str,
    labels: DataFrame | None = None,
    id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """The audit of filters given as failure conditions, with one more filter that removes repeated texts.

    `failures` maps a letter to a condition on the document's own columns (null counts as passed); they run in the
    mapping's order of bits. `repeated` is the letter of the filter that fails a document whose text is also that of a
    row with a smaller id, table-wide, removed or not. A null text is empty, so null and empty texts repeat each other. A row without id
    repeats nothing and is repeated by nothing. Rows with one id and text are counted one by one and share the verdict.
    A null `part` is the empty string. `labels` (doc_id, quality, toxic) says what is lost: a document is good (toxic) if
    any of its rows there has quality 1 (toxic 1); without a row it is neither. Other columns and their names do not
    matter; an empty table gives no rows.

    Texts are read once and leave the scan as a 32-byte digest. Equal rows are added up before every shuffle, so a
    text or label that many documents share is no hot key.
    """
    names = [*failures, repeated]
    mask: Column = F.lit(0)
    for place, condition in enumerate(failures.values()):
        mask = mask + F.when(condition, F.lit(1 << place)).otherwise(0)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    judged = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        mask.alias("mask"),
    )
    rows = judged.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    if labels is None:
        marked = rows.select("*", F.lit(0).alias("is_good"), F.lit(0).alias("is_toxic"))
    else:
        known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
            F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("is_good"),
            F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("is_toxic"),
        )
        marked = rows.join(known, rows["id"] == known["label_id"], "left").fillna(0, ["is_good", "is_toxic"])

    last = 1 << len(failures)
    sums = [
        F.sum("n").alias("docs"),
        F.sum(F.col("n") * F.col("is_good")).alias("good"),
        F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"),
    ]
    # Every document with an id counts as repeated first; the ones with the smallest id of their text are then moved over.
    by_id = marked.groupBy("id", "digest", "part", "mask").agg(*sums)
    everyone = by_id.select(
        "part",
        (F.col("mask") + F.when(F.col("id").isNull(), 0).otherwise(last)).alias("mask"),
        "docs",
        "good",
        "toxic",
    )
    firsts = (
        by_id.groupBy("id", "digest")
        .agg(F.collect_list(F.struct("part", "mask", "docs", "good", "toxic")).alias("items"))
        .groupBy("digest")
        .agg(F.min_by("items", "id").alias("items"))  # rows without id have no part in it
        .select(F.inline("items"))
    )
    off = [(-F.col(c)).alias(c) for c in ("docs", "good", "toxic")]
    back = F.struct("part", (F.col("mask") + last).alias("mask"), *off)
    moved = firsts.select(F.inline(F.array(F.struct("part", "mask", "docs", "good", "toxic"), back)))
    return audit_masks(everyone.unionAll(moved), "".join(names))


def text_failures(text: str = "text") -> dict[str, Column]:
    """The four conditions on a text alone: A few words, B repeated words, C many capitals, D marks.

    Words are maximal runs outside 0x20 and 0x09-0x0D, compared with case; a null text is empty.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(whole, F.lit("[A-Z]")) * 100 > F.length(whole) * 10,
        "D": F.regexp_like(whole, F.lit(r"[#$%&*|]")),
    }
