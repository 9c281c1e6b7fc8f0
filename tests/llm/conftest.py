import os

import pytest
from llm_helpers import SF


@pytest.fixture(scope="session")
def reference():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("sample tables are not here")
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection
