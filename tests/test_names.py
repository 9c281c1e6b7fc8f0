"""Repositories that change and reuse names."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.unsigned import as_bits
from tidemark.operators.equivalence import results_equivalent
from tidemark.operators.names import (
    current_names,
    fold_names,
    follow_name,
    lookup_from_names,
    name_history,
    names_monthly,
    read_names,
    write_names,
)
from tidemark.plans.cards import repo_lookup
from tidemark.sources.bus import read_event_stream, to_bus_messages
from tidemark.sources.store import batch_load
from tidemark.streaming.ingest import Sinks, start_ingest


def renamed(event):
    """Repository 1: a, then b, then c; repository 2: x, then a; repository 3 goes from y to z and back."""
    rows = [(1, "a", 1), (1, "a", 2), (2, "x", 2), (1, "b", 3), (2, "a", 4), (3, "y", 4), (3, "z", 5), (1, "c", 6), (2, "a", 7), (3, "y", 8)]
    types = ["PushEvent", "ForkEvent", "IssuesEvent", "WatchEvent"]
    return event(
        *[
            {"repo_id": i, "repo_name": n, "created_at": f"2024-0{m}-01 00:00:00", "event_type": types[k % 4], "event_id": as_bits((1 << 63) - 4 + k)}
            for k, (i, n, m) in enumerate(rows)
        ]
    )


def test_lookups_equal_those_of_the_events(spark, event, tmp_path):
    events, path = renamed(event), str(tmp_path / "names")
    for number in (0, 1, 2, 1):
        write_names(events.filter(F.pmod("event_id", F.lit(3)) == number), path, batch_load("s", number))
    fold_names(spark, path, "s", 2)
    names = read_names(spark, path)
    for name in ("a", "b", "c", "x", "y", "z", "no such"):
        assert results_equivalent(lookup_from_names(names, name), repo_lookup(events, name)), name
    assert {r.repo_id: r.repo_name for r in current_names(names).collect()} == {1: "c", 2: "a", 3: "y"}
    assert [(r.repo_id, r.repo_name) for r in follow_name(names, "a").collect()] == [(2, "a"), (1, "c")]
    assert follow_name(names, "no such").count() == 0


def test_periods(event):
    rows = {(r.repo_id, r.repo_name): (r.valid_from.month, r.valid_to and r.valid_to.month) for r in name_history(names_monthly(renamed(event))).collect()}
    assert rows == {(1, "a"): (1, 3), (1, "b"): (3, 6), (1, "c"): (6, None), (2, "x"): (2, 4), (2, "a"): (4, None), (3, "y"): (4, 8), (3, "z"): (5, None)}
    assert name_history(names_monthly(renamed(event).limit(0))).count() == 0


def test_a_name_is_found_by_its_own_rows(spark, event, tmp_path):
    path = str(tmp_path / "names")
    write_names(renamed(event), path, "a")
    plan = lookup_from_names(read_names(spark, path), "b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo_name,b)" in plan


def test_stream_keeps_names(spark, event, tmp_path):
    folder = str(tmp_path / "messages")
    places = [F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.lit(1).cast("bigint").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp")]
    to_bus_messages(renamed(event)).select("key", "value", *places).write.parquet(folder)
    sinks = Sinks(str(tmp_path / "out"))
    start_ingest(read_event_stream(spark, files=folder), sinks, str(tmp_path / "cp"), {"availableNow": True}, names=True).awaitTermination()
    row = lookup_from_names(read_names(spark, sinks.names), "a").first()
    assert (row.repo_id, row.total_events) == (2, 4)
    assert read_names(spark, sinks.names).agg(F.min("since")).first()[0] == datetime(2024, 1, 1)
