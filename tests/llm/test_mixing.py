import random

import pytest
from llm_helpers import SF, same_rows

from tidemark.llm.mixing import mix_sources, mixed_documents, source_targets
from tidemark.llm.queries import QUERIES, SQL


def test_query_equals_sql(spark, reference):
    same_rows(QUERIES["op9_weighted_fair_mix"](spark, SF), reference, SQL["op9_weighted_fair_mix"])


def filled(sizes, weights=(5, 2, 1)):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * level) for s in order}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets(spark):
    draw = random.Random(3)
    for n in (1, 2, 7, 30):
        sizes = {("s" + str(i) if i else None): draw.choice([0, 1, 10, 500, draw.randrange(1, 10_000)]) for i in range(n)}
        frame = spark.createDataFrame(list(sizes.items()), "source STRING, source_size BIGINT")
        got = {r.source: r.target for r in source_targets(frame).collect()}
        assert got == pytest.approx(filled(sizes))


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING, mix INT")


def test_taken_words_come_near_targets(spark):
    draw = random.Random(9)
    rows = [(i, None if i % 3 == 0 else f"s{i % 7}", "w " * draw.randrange(40), i) for i in range(600)]
    rows += [(None, "s1", None, 1), (7, "s2", "", 1), (8, "s2", "x " * 3000, 1)]
    docs = make(spark, rows)
    first = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(3)).collect()
    assert sorted(first, key=repr) == sorted(again, key=repr) and len(first) == len(rows)
    targets, taken = {}, {}
    for r in first:
        assert r.mix.size == len((r.text or "").split()) and 0 <= r.mix.copies <= 2
        targets[r.source] = r.mix.target
        taken[r.source] = taken.get(r.source, 0) + r.mix.size * r.mix.copies
    for source, target in targets.items():
        longest = max(r.mix.size for r in first if r.source == source)
        assert abs(taken[source] - target) <= longest
    total = sum(r.mix.size for r in first)
    assert 1.5 * total - 3000 <= sum(taken.values()) <= 1.5 * total

    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.mix.copies for r in first)


def test_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x y", 7, 8, 9, 10)], "doc_id INT, source STRING, text STRING, size INT, target INT, last INT, weight INT")
    row = mix_sources(docs).first()
    assert (row.size, row.target, row.last, row.weight, row.mix.size) == (7, 8, 9, 10, 2)
    assert mixed_documents(docs).columns == docs.columns


def test_empty_and_wordless(spark):
    assert mix_sources(make(spark, []).limit(0)).collect() == []
    rows = mix_sources(make(spark, [(1, "a", None, 1), (2, None, " ", 1)])).collect()
    assert [r.mix.copies for r in rows] == [0, 0] and [r.mix.target for r in rows] == [0.0, 0.0]


def test_repeated_rows_are_cut_one_by_one(spark, reference):
    """300 equal rows and 100 others in one source; the cut falls among the equal ones."""
    rows = [(7, "big", "w " * 10, 1)] * 300 + [(1000 + i, "big", "v " * 10, 1) for i in range(100)]
    rows += [(5000 + i, f"s{i % 3}", "u " * 10, 1) for i in range(120)]
    docs = make(spark, rows).repartition(3)
    found = mix_sources(docs).collect()
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert abs(sum(r.mix.size * r.mix.copies for r in own) - own[0].mix.target) <= 10
    assert len({r.mix.copies for r in found if r.doc_id == 7}) == 2
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") + "/mix-repeated"
    docs.drop("mix").write.parquet(path)
    ours = mix_sources(spark.read.parquet(path)).selectExpr("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.size * mix.copies AS taken")
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    same_rows(ours, connection, SQL["op9_weighted_fair_mix"])


def test_columns_of_the_mixing_itself_stay(spark):
    rows = [(1, "a", "x y", 7, 8, 9, 10, 11, 12)]
    docs = spark.createDataFrame(rows, "doc_id INT, source STRING, text STRING, __h1 INT, __size INT, __H2 INT, __row INT, __copy INT, __mix INT")
    assert {tuple(r) for r in mixed_documents(docs).collect()} == set(rows)
    assert tuple(mix_sources(docs).first())[:9] == rows[0]
