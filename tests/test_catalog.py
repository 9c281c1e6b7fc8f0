"""Every named query against its reference SQL on the smallest sample tables."""

import os

import pytest

from tidemark.samples import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")


@pytest.fixture(scope="module")
def reference():
    connection = duckdb.connect()
    for table in ("events", "part"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def comparable(rows, columns, order):
    def value(v):
        return float(f"{v:.12g}") if isinstance(v, float) else v

    return sorted([tuple(value(row[columns.index(c)]) for c in order) for row in rows], key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_its_sql(spark, reference, name):
    frame = catalog.QUERIES[name](spark, SF)
    result = reference.execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    ours = comparable([tuple(r) for r in frame.collect()], frame.columns, order)
    assert ours == comparable(result.fetchall(), columns, order)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark)
    assert rows.columns == ["repo_id", "repo_name", "stars"] and rows.count() > 0


def test_a_missing_library_costs_only_the_optional_part(monkeypatch):
    import builtins
    import importlib
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name in ("tidemark.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    monkeypatch.delitem(sys.modules, "tidemark.llm.queries", raising=False)
    with pytest.warns(UserWarning, match="ahocorasick"):
        importlib.reload(entry)
    assert set(entry.queries()) == set(catalog.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
