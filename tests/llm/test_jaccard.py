import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import SF, same_rows

from tidemark.llm import jaccard
from tidemark.llm.jaccard import Sets, bands, class_ids, index_keys, jaccard_components, keep_one_of_each, sets_of, spaces_of
from tidemark.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, n):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def plain(rows, n, percent):
    sets = [plain_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(out, key=repr)


def some_rows(seed=1, count=120, passage=0):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = draw.choices(vocabulary, k=60)
    rows = []
    for i in range(count):
        if rows and i % 2:
            words = (rows[draw.randrange(len(rows))][1] or "").split(" ")
            for _ in range(draw.choice([0, 1, 1, 2, 3, 6])):
                at = draw.randrange(len(words) or 1)
                words[at : at + draw.randrange(2)] = draw.choices(vocabulary, k=draw.randrange(3))
        else:
            words = draw.choices(vocabulary, k=draw.choice([1, 2, 3, 4, 5, 8, 15, 40, 90, 250]))
            if i % 3 < passage:
                words = shared + words[:20]
        rows.append((i * 37 % 1009, " ".join(words)))
    return rows


def hashed(sizes, draw):
    hashes = [np.sort(draw.choice(1 << 60, n, replace=False).astype(np.uint64)) for n in sizes]
    return hashes


def as_sets(hashes):
    return Sets(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]), np.concatenate(hashes), np.array([len(h) for h in hashes]))


@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize("percent", [85, 80, 60])
def test_linked_sets_always_share_a_key(crowded, percent):
    """Pairs with the largest difference that still links, over all small sizes and some large ones."""
    draw = np.random.default_rng(percent + crowded)
    for n in [*range(1, 60), 97, 300, 1500] * 6:
        larger = int(draw.integers(n, n * 100 // percent + 1))
        shared = -(-percent * (n + larger) // (100 + percent))
        if shared > n:
            continue
        pool = draw.choice(1 << 60, n + larger - shared, replace=False).astype(np.uint64)
        pair = as_sets([np.sort(pool[:n]), np.sort(pool[n - shared :])])
        assert 100 * shared >= percent * len(pool)
        owner, space = spaces_of(pair.size, percent)
        entry, key = index_keys(pair, owner, space, percent, crowded)
        found = [set(key[owner[entry] == k].tolist()) for k in (0, 1)]
        assert found[0] & found[1], (n, larger)


def test_sets_with_few_filled_segments_still_meet():
    """Sets whose elements fall into one or two segments: what cannot be made up for by neighbourhoods."""
    lower, most = bands(85)
    draw = np.random.default_rng(0)
    met = 0
    for _ in range(300):
        base = draw.choice(1 << 60, 40_000).astype(np.uint64)
        seed = np.uint64(0xA3B195354A39B70D)
        n = int(draw.integers(13, 30))
        space = int(np.searchsorted(lower, n, "right") - 1)
        segment = jaccard.mix(base + seed) % np.uint64(most[space] + 1)
        chosen = np.concatenate([base[segment == 0][: n - 1], base[segment == 1][:1]])
        other = np.concatenate([chosen[1:-1], base[segment == 0][n : n + 1], chosen[-1:]])
        pair = as_sets([np.sort(chosen), np.sort(other)])
        if 100 * (n - 1) < 85 * (n + 1):
            continue
        owner, spaces = spaces_of(pair.size, 85)
        entry, key = index_keys(pair, owner, spaces, 85, False)
        found = [set(key[owner[entry] == k].tolist()) for k in (0, 1)]
        assert found[0] & found[1]
        met += 1
    assert met > 100


@pytest.mark.parametrize("n", [1, 4, 5])
def test_sets_equal_brute_force(n):
    texts = [None, "", " \t", "a", "A b", "a b c d", "a b c d e a b c d e", "É é ñ\x85x y", *[t for _, t in some_rows(5, 30)]]
    got = sets_of(pa.array(texts), n)
    assert got.size.tolist() == [len(plain_set(t, n)) for t in texts]
    ids = class_ids(got)
    for i in range(len(texts)):
        for j in range(i):
            if got.size[i] and got.size[j]:
                assert (ids[i] == ids[j]) == (plain_set(texts[i], n) == plain_set(texts[j], n))


def test_sketches_never_rule_out_a_link():
    draw = np.random.default_rng(7)
    passed = 0
    for n in [3, 9, 40, 200, 1500] * 20:
        shared = int(draw.integers(0, n + 1))
        pool = draw.choice(1 << 60, 2 * n - shared, replace=False).astype(np.uint64)
        pair = as_sets([np.sort(pool[:n]), np.sort(pool[n - shared :])])
        owner, space = spaces_of(pair.size, 85)
        common = min(space[owner == 0].max(), space[owner == 1].max())
        one, two = (np.frombuffer(x, np.uint8) for x in jaccard.parity_sketches(pair, np.array([0, 1]), np.array([common] * 2), 85))
        differing = np.bitwise_count(one ^ two).sum()
        assert differing <= 2 * n - 2 * shared
        links = jaccard.similar(pair.hash[:n], pair.hash[n:], 85)
        may = bool(jaccard.may_link(np.array([differing]), np.array([n]), np.array([n]), 85)[0])
        assert may or not links
        passed += may and not links
    assert passed < 25


def test_shared_passages_are_not_tested_pairwise(spark, monkeypatch):
    """Unrelated texts with one long passage: the tested pairs grow with their number, not with its square."""
    tested = {}
    for count in (150, 300):
        draw = random.Random(count)
        passage = [f"p{i}" for i in range(150)]
        rows = [(i, " ".join([f"w{draw.randrange(10**6)}" for _ in range(60)] + passage)) for i in range(count)]
        seen, real = [], jaccard._verified
        monkeypatch.setattr(jaccard, "_verified", lambda pairs, *more: (seen.append(pairs.count()), real(pairs, *more))[1])
        docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
        found = jaccard_components(docs)
        assert found.filter("component_id != doc_id").count() == 0
        monkeypatch.undo()
        tested[count] = sum(seen)
    assert tested[300] <= 2.5 * max(tested[150], 100), tested


def triples(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("ratio, held, passage, percent", [(32, 1 << 25, 0, 85), (0, 1 << 25, 2, 80), (32, 200, 2, 80)])
def test_equals_brute_force(spark, monkeypatch, ratio, held, passage, percent):
    monkeypatch.setattr(jaccard, "COMPARISONS_PER_ENTRY", ratio)
    monkeypatch.setattr(jaccard, "MOST_HELD", held)  # groups in several blocks
    monkeypatch.setattr(jaccard, "SPREAD", 5)
    rows = some_rows(2 + passage, 90, passage)
    rows += [(2000, None), (2001, ""), (2001, " "), (None, rows[0][1]), (None, "only here"), (2002, rows[3][1]), (2002, rows[3][1]), (2002, rows[7][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id BIGINT, text STRING, cid INT").repartition(3)
    got = jaccard_components(docs, words=4, percent=percent)
    assert triples(got) == plain(rows, 4, percent)


def test_one_row_of_each_component_stays(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (9, "", "z"), (9, "", "z"), (None, None, "n"), (None, "p q r s t", "m"), (1, "u v w x y", "k")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    kept = keep_one_of_each(docs, words=5, percent=80)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6], rows[7]], key=repr)
    assert jaccard_components(docs.limit(0)).collect() == []


def test_columns_with_clashing_names_stay(spark):
    rows = [(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 5, 6, 7, 8), (3, "x", 9, 9, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, __hash INT, __id INT, __filled INT, __text_hash INT")
    assert sorted(map(tuple, keep_one_of_each(docs).collect())) == [rows[0], rows[2]]


def test_query_equals_sql(spark, reference):
    same_rows(QUERIES["op6_partition_join"](spark, SF), reference, SQL["op6_partition_join"])
