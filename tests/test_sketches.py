"""Daily sketches against exact figures, on keys that do not fit them."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sketches import (
    CORPUS_DAILY,
    FREQUENT_KEYS,
    KEYS_DAILY,
    KLL_RANK_ERROR,
    PAYLOAD_DAILY,
    SKETCH_SCHEMAS,
    corpus_from_sketches,
    fold_sketches,
    frequency_error,
    heavy_keys,
    key_bounds,
    read_sketches,
    sizes_from_sketches,
    write_sketches,
)
from tidemark.schema import CANONICAL
from tidemark.sources.bus import read_event_stream, to_bus_messages
from tidemark.sources.store import batch_load, month_loads
from tidemark.streaming.ingest import Sinks, start_ingest

ROWS = 120_000


@pytest.fixture(scope="module")
def events(spark):
    """A repository with a sixth of all events, 30 000 others; every actor is new; sizes spread unevenly."""
    n = F.col("id")
    values = {
        "event_id": n,
        "event_type": F.when(n % 3 == 0, "PushEvent").otherwise("WatchEvent"),
        "created_at": F.timestamp_add("MINUTE", n % 80_000, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")),
        "actor_id": n + 7,
        "actor_login": F.lit("a"),
        "repo_id": F.when(n % 6 == 0, F.lit(-5).cast("bigint")).otherwise(n % 30_000),
        "repo_name": F.lit("r"),
        "org_id": F.lit(0).cast("bigint"),
        "language": F.lit(""),
        "payload_size": (n % 1000) * (n % 1000),
        "ref": F.lit(""),
    }
    return spark.range(ROWS).select(*[values[f.name].alias(f.name) for f in CANONICAL.fields]).persist()


@pytest.fixture(scope="module")
def stored(spark, events, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sketches"))
    for number in (0, 1, 2, 3, 1):
        write_sketches(events.filter(F.col("event_id") % 4 == number), root, batch_load("s", number))
    for name in SKETCH_SCHEMAS:
        fold_sketches(spark, root, name, "s", 3)
    return root


def test_folded_and_replayed(spark, stored):
    for name in SKETCH_SCHEMAS:
        assert len(month_loads(spark, f"{stored}/{name}", 202401)) == 2
    assert read_sketches(spark, stored, CORPUS_DAILY).agg(F.sum("events")).first()[0] == ROWS


def test_corpus_figures(spark, events, stored):
    row = corpus_from_sketches(read_sketches(spark, stored, CORPUS_DAILY), "2024-03-01").first()
    exact = events.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count_distinct("repo_id").alias("r")).first()
    assert (row.events_total, row.oldest, row.newest) == (ROWS, exact.a, exact.b)
    assert abs(row.distinct_actors - ROWS) < 0.03 * ROWS and abs(row.distinct_repos - exact.r) < 0.03 * exact.r
    few = read_sketches(spark, stored, CORPUS_DAILY, "2024-01-03", "2024-01-05")
    assert {r.day for r in few.collect()} == {date(2024, 1, 3), date(2024, 1, 4)}
    part = events.filter((F.col("created_at") >= datetime(2024, 1, 3)) & (F.col("created_at") < datetime(2024, 1, 5)))
    assert corpus_from_sketches(few, "2024-03-01").first().events_total == part.count()


def test_months_outside_are_not_read(spark, stored):
    plan = read_sketches(spark, stored, CORPUS_DAILY, "2024-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "ym" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_sizes_at_ranks(spark, events, stored):
    found = sizes_from_sketches(read_sketches(spark, stored, PAYLOAD_DAILY), (0.1, 0.5, 0.99))
    for row in found.collect():
        own = events.filter(F.col("event_type") == row.event_type)
        exact = own.agg(F.count("*").alias("n"), F.min("payload_size").alias("a"), F.max("payload_size").alias("b")).first()
        assert (row.events, row.min_size, row.max_size) == tuple(exact)
        for rank, value in ((0.1, row.p10), (0.5, row.p50), (0.99, row.p99)):
            below = own.filter(F.col("payload_size") < value).count() / exact.n
            upto = own.filter(F.col("payload_size") <= value).count() / exact.n
            assert below - KLL_RANK_ERROR <= rank <= upto + KLL_RANK_ERROR


def test_bounds_and_heavy_keys(spark, events, stored):
    days = read_sketches(spark, stored, KEYS_DAILY)
    for key in FREQUENT_KEYS:
        row = key_bounds(days, key).first()
        largest = events.groupBy(key).count().agg(F.max("count")).first()[0]
        assert row.events == ROWS and row.largest_least <= largest <= row.largest_most
        assert row.largest_most - row.largest_least <= frequency_error(3000) * ROWS + 1
    heavy = heavy_keys(events, days, "repo_id", 0.01).collect()
    assert [(r.repo_id, r.n, r.share) for r in heavy] == [(-5, ROWS // 6, 1 / 6)]
    assert heavy_keys(events, days, "actor_id", 0.01).count() == 0
    with pytest.raises(ValueError):
        heavy_keys(events, days, "repo_id", 0.0001)


def test_no_events(spark, events, tmp_path):
    root = str(tmp_path)
    write_sketches(events.limit(1), root, "a")
    none = {name: read_sketches(spark, root, name, "2030-01-01") for name in SKETCH_SCHEMAS}
    row = corpus_from_sketches(none[CORPUS_DAILY], "2024-03-01").first()
    assert (row.events_total, row.oldest, row.ingest_lag_seconds, row.distinct_repos) == (0, None, None, 0)
    assert sizes_from_sketches(none[PAYLOAD_DAILY]).count() == 0 and key_bounds(none[KEYS_DAILY], "repo_id").count() == 0
    assert heavy_keys(events, none[KEYS_DAILY], "repo_id", 0.01).count() == 0


def test_stream_maintains_sketches(spark, event, tmp_path):
    folder = str(tmp_path / "messages")
    rows = to_bus_messages(event(*[{"repo_id": i % 4} for i in range(9)]))
    places = [F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("key").cast("bigint").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp")]
    rows.select("key", "value", *places).write.parquet(folder)
    sinks = Sinks(str(tmp_path / "out"))
    start_ingest(read_event_stream(spark, files=folder), sinks, str(tmp_path / "cp"), {"availableNow": True}, sketches=True).awaitTermination()
    row = corpus_from_sketches(read_sketches(spark, sinks.sketches, CORPUS_DAILY), "2024-06-01").first()
    assert (row.events_total, row.distinct_repos, row.distinct_actors) == (9, 4, 9)
