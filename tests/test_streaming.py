"""The continuous write path: batches, crashes, duplicates, audit."""

import json
import time
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators.rollups import merge_stored, read_rollup, repo_stars_hourly
from tidemark.operators.equivalence import results_equivalent
from tidemark.schema import ACTIVITY, LANGUAGE_DAILY, MESSAGE, REPO_STARS_HOURLY
from tidemark.sources.archive import hour_path, parse_hour
from tidemark.sources.bus import read_event_stream, to_bus_messages
from tidemark.sources.store import month_loads, read_dead_letters, read_events
from tidemark.streaming import ingest
from tidemark.streaming.audit import batch_sizes, end_offsets_of, ingest_health, lag_by_partition, read_audit
from tidemark.streaming.ingest import Sinks, dedup_stream, fold_archive, ingest_archive, start_ingest

NOW = {"availableNow": True}


@pytest.fixture
def land(spark, tmp_path):
    """Put one file of messages into the source folder."""
    folder = tmp_path / "messages"

    def put(messages, first_offset):
        rows = messages.select("key", "value").collect()
        data = [(r.key, r.value, "events", 0, first_offset + i, None) for i, r in enumerate(rows)]
        spark.createDataFrame(data, MESSAGE).coalesce(1).write.mode("append").parquet(str(folder))
        return str(folder)

    return put


def run(spark, folder, sinks, tmp_path, **more):
    stream = read_event_stream(spark, files=folder, max_files=1)
    start_ingest(stream, sinks, str(tmp_path / "checkpoint"), NOW, **more).awaitTermination()


def forty(event):
    return event(*[{"created_at": f"2024-05-06 10:{i:02d}:00", "repo_id": i % 3, "language": "go"} for i in range(40)])


@pytest.mark.parametrize("victim", ["write_events", "maintain_rollups", "write_audit"])
def test_crash_between_write_and_commit_leaves_no_trace(spark, event, land, tmp_path, monkeypatch, victim):
    events = forty(event)
    land(to_bus_messages(events.filter("event_id <= 20")), 0)
    folder = land(to_bus_messages(events.filter("event_id > 20")), 20)
    sinks = Sinks(str(tmp_path / "out"))
    real, calls = getattr(ingest, victim), []

    def crashing(*args):
        real(*args)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("executor lost")

    monkeypatch.setattr(ingest, victim, crashing)
    with pytest.raises(Exception):
        run(spark, folder, sinks, tmp_path, retries=0)
    monkeypatch.undo()
    run(spark, folder, sinks, tmp_path)

    stored = read_events(spark, sinks.events)
    assert stored.count() == 40 and stored.select("event_id").distinct().count() == 40
    stars = merge_stored(REPO_STARS_HOURLY, read_rollup(spark, sinks.rollups, REPO_STARS_HOURLY))
    assert results_equivalent(stars, repo_stars_hourly(events))
    for name in (LANGUAGE_DAILY, ACTIVITY):
        assert read_rollup(spark, sinks.rollups, name).agg(F.sum("events")).first()[0] == 40
    audit = read_audit(spark, sinks.audit)
    assert audit.agg(F.sum("inserted")).first()[0] == 40
    assert sorted(r.batch_id for r in audit.collect()) == [0, 1]


def test_a_failing_sink_is_retried_with_the_same_batch(spark, event, land, tmp_path, monkeypatch):
    folder = land(to_bus_messages(forty(event)), 0)
    sinks = Sinks(str(tmp_path / "out"))
    real, calls, waits = ingest.maintain_rollups, [], []

    def flaky(*args):
        real(*args)
        calls.append(1)
        if len(calls) < 4:
            raise OSError("storage does not answer")

    monkeypatch.setattr(ingest, "maintain_rollups", flaky)
    clock = SimpleNamespace(sleep=waits.append, perf_counter=time.perf_counter)
    monkeypatch.setattr(ingest, "time", clock)
    run(spark, folder, sinks, tmp_path)
    assert (len(calls), waits) == (4, [1, 2, 4])
    assert read_events(spark, sinks.events).count() == 40
    assert read_rollup(spark, sinks.rollups, ACTIVITY).agg(F.sum("events")).first()[0] == 40
    assert [r.batch_id for r in read_audit(spark, sinks.audit).collect()] == [0]


def test_poison_goes_to_dead_letters_and_late_rows_still_count(spark, event, land, tmp_path):
    sinks = Sinks(str(tmp_path / "out"))
    good = to_bus_messages(event({}, {"created_at": "2019-01-01 03:00:00"}))
    bad = spark.createDataFrame([("k", "not json"), ("k", "{}")], "key STRING, value STRING")
    folder = land(good.unionByName(bad), 0)
    run(spark, folder, sinks, tmp_path, end_offsets=lambda: {0: 10})
    assert read_events(spark, sinks.events).count() == 2
    letters = read_dead_letters(spark, sinks.dead_letters).orderBy("source_offset").collect()
    assert [(r.value, r.source_offset) for r in letters] == [("not json", 2), ("{}", 3)]
    # A second run brings an event for an hour long past: it is added to that hour.
    land(to_bus_messages(event({"event_id": 9, "created_at": "2019-01-01 03:30:00"})), 4)
    run(spark, folder, sinks, tmp_path)
    stars = merge_stored(REPO_STARS_HOURLY, read_rollup(spark, sinks.rollups, REPO_STARS_HOURLY, [201901]))
    assert [(r.hour, r.stars) for r in stars.collect()] == [(datetime(2019, 1, 1, 3), 2)]
    audit = read_audit(spark, sinks.audit)
    first = audit.filter("batch_id = 0").first()
    assert (first.consumed, first.inserted, first.dead_lettered, first.position, first.end_offset) == (4, 2, 2, 4, 10)
    assert first.latency_seconds > 0
    # The second batch did not know the end of its partition: the lag of the first one stands.
    assert {r.partition: r.lag for r in lag_by_partition(audit).collect()} == {0: 6, None: 6}
    health = ingest_health(audit, "1 day").collect()
    assert sum(h.consumed for h in health) == 5
    sizes = {r.up_to: r.batches for r in batch_sizes(audit).collect()}
    assert (sizes[1], sizes[10], sizes[None]) == (1, 2, 2)


def test_health_of_an_idle_interval(spark):
    audit = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 0, 0, 0, 0, 5, None, 0.1), (2, datetime(2024, 1, 1, 0, 5), 0, 120, 90, 30, 5, 9, 0.2)],
        "batch_id BIGINT, ts TIMESTAMP_NTZ, partition INT, consumed BIGINT, inserted BIGINT, dead_lettered BIGINT, "
        "position BIGINT, end_offset BIGINT, latency_seconds DOUBLE",
    )
    rows = ingest_health(audit).orderBy("interval_start").collect()
    assert [(r.dead_letter_percent, r.consumed_per_second) for r in rows] == [(0.0, 0.0), (25.0, 2.0)]


def test_end_offsets_from_progress():
    progress = {"sources": [{"latestOffset": {"events": {"0": 17, "3": 4}}}, {"latestOffset": None}]}
    assert end_offsets_of(progress) == {0: 17, 3: 4}
    assert end_offsets_of({"sources": [{"latestOffset": json.dumps({"events": {"1": 2}})}]}) == {1: 2}


def test_dedup_stream(spark, event, land, tmp_path):
    """Copies within a batch and across batches; ids and times run backwards, nothing new is lost."""
    events = event(*[{"event_id": 100 - i, "created_at": f"2024-05-{20 - i:02d} 10:00:00"} for i in range(10)])
    land(to_bus_messages(events.filter("event_id > 95").unionByName(events.filter("event_id = 99"))), 0)
    folder = land(to_bus_messages(events), 5)
    out = str(tmp_path / "out")
    from tidemark.operators.validate import check_messages, valid_events

    stream = valid_events(check_messages(read_event_stream(spark, files=folder)))
    query = dedup_stream(stream, "1 hour").writeStream.format("parquet").option("path", out)
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert results_equivalent(spark.read.parquet(out).select(*events.columns), events)


def test_archive_load_is_replay_safe(spark, tmp_path):
    import gzip

    for hour, count in (("2024-06-03-9", 3), ("2024-06-03-10", 2)):
        with gzip.open(hour_path(str(tmp_path), parse_hour(hour)), "wt") as out:
            for i in range(count):
                out.write(json.dumps({
                    "id": f"{hour[-1]}{i}", "type": "WatchEvent", "created_at": "2024-06-03T09:00:00Z",
                    "actor": {"id": 1, "login": "a"}, "repo": {"id": 2, "name": "b/c"}, "payload": {"action": "started"},
                }) + "\n")
            out.write("{broken\n")
    sinks = Sinks(str(tmp_path / "out"))
    for _ in range(2):
        counts = ingest_archive(spark, str(tmp_path), "2024-06-03-9", "2024-06-03-11", sinks)
        assert counts["seen"] == 7 and counts["malformed_json"] == 2
    assert read_events(spark, sinks.events).count() == 5
    assert read_rollup(spark, sinks.rollups, REPO_STARS_HOURLY).agg(F.sum("stars")).first()[0] == 5


def test_a_second_checkpoint_neither_destroys_nor_doubles(spark, event, land, tmp_path):
    folder = land(to_bus_messages(forty(event)), 0)
    sinks = Sinks(str(tmp_path / "out"))
    run(spark, folder, sinks, tmp_path)
    with pytest.raises(ValueError):  # the same source from the start once more
        run(spark, folder, sinks, tmp_path / "lost")
    run(spark, folder, sinks, tmp_path / "other", beside=True)
    assert read_events(spark, sinks.events).count() == 80
    assert read_rollup(spark, sinks.rollups, ACTIVITY).agg(F.sum("events")).first()[0] == 80


def test_overlapping_archive_ranges_replace_the_hours_they_share(spark, tmp_path):
    import gzip

    for hour in (1, 2, 3):
        with gzip.open(hour_path(str(tmp_path), parse_hour(f"2024-06-03-{hour}")), "wt") as out:
            for i in range(hour):
                out.write(json.dumps({
                    "id": f"{hour}{i}", "type": "WatchEvent", "created_at": f"2024-06-03T0{hour}:00:00Z",
                    "actor": {"id": 1, "login": "a"}, "repo": {"id": 2, "name": "b/c"}, "payload": {},
                }) + "\n")
    sinks = Sinks(str(tmp_path / "out"))
    for start, end in (("2024-06-03-1", "2024-06-03-3"), ("2024-06-03-1", "2024-06-03-4"), ("2024-06-03-2", None)):
        ingest_archive(spark, str(tmp_path), start, end, sinks)
    assert read_events(spark, sinks.events).count() == 6
    assert read_rollup(spark, sinks.rollups, REPO_STARS_HOURLY).agg(F.sum("stars")).first()[0] == 6


def test_settled_archive_hours_fold(spark, tmp_path):
    import gzip

    for hour in range(6):
        with gzip.open(hour_path(str(tmp_path), parse_hour(f"2024-06-03-{hour}")), "wt") as out:
            for i in range(hour + 1):
                out.write(json.dumps({
                    "id": f"{hour}{i}", "type": "WatchEvent", "created_at": f"2024-06-03T0{hour}:00:00Z",
                    "actor": {"id": 1, "login": "a"}, "repo": {"id": 2, "name": "b/c"}, "payload": {},
                }) + "\n")
    sinks = Sinks(str(tmp_path / "out"))
    everything = ("2024-06-03-0", "2024-06-03-6")
    ingest_archive(spark, str(tmp_path), *everything, sinks)
    for _ in range(2):
        fold_archive(spark, sinks, "2024-06-03-1", "2024-06-03-5")
    assert len(month_loads(spark, sinks.events, 202406)) == 3
    for part in (("2024-06-03-2", "2024-06-03-4"), ("2024-06-03-0", "2024-06-03-3"), ("2024-06-03-4", None)):
        with pytest.raises(ValueError, match="folded"):
            ingest_archive(spark, str(tmp_path), *part, sinks)
    ingest_archive(spark, str(tmp_path), "2024-06-03-5", None, sinks)
    for _ in range(2):
        assert read_events(spark, sinks.events).count() == 21
        for name, measure in ((REPO_STARS_HOURLY, "stars"), (ACTIVITY, "events")):
            assert read_rollup(spark, sinks.rollups, name).agg(F.sum(measure)).first()[0] == 21
        ingest_archive(spark, str(tmp_path), *everything, sinks)  # covers the fold and takes its place
    assert len(month_loads(spark, sinks.events, 202406)) == 6


def test_programming_errors_are_not_retried(spark, event, land, tmp_path, monkeypatch):
    folder = land(to_bus_messages(forty(event)), 0)
    calls = []

    def wrong(*args):
        calls.append(1)
        raise TypeError("a mistake")

    monkeypatch.setattr(ingest, "maintain_rollups", wrong)
    with pytest.raises(Exception):
        run(spark, folder, Sinks(str(tmp_path / "out")), tmp_path)
    assert len(calls) == 1
