"""The session zone must not matter, not even in the hour its clocks skip."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timestamps import hour_of, micros_of, month_number, parse_rfc3339, second_of, to_rfc3339
from tidemark.operators.admission import sliding_window_admission
from tidemark.plans.activity import activity_heatmap
from tidemark.operators.rollups import activity_weekday_hour
from tidemark.plans.completeness import missing_hours
from tidemark.plans.corpus import corpus_stats
from tidemark.sources.bus import to_bus_messages
from tidemark.sources.store import read_events, write_events

SKIPPED = "2024-03-10 02:30:00"  # does not exist in New York


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_expressions(spark, zone):
    ts = F.expr("TIMESTAMP_NTZ '2024-03-10 02:30:15.123456'")
    row = spark.range(1).select(
        hour_of(ts).alias("hour"),
        second_of(ts).alias("second"),
        micros_of(ts).alias("micros"),
        month_number(ts).alias("month"),
        to_rfc3339(second_of(ts)).alias("text"),
        parse_rfc3339(F.lit("2024-03-10T02:30:15.9Z")).alias("parsed"),
        parse_rfc3339(F.lit("2024-03-10T02:30:15-05:00")).alias("shifted"),
        micros_of(F.expr("TIMESTAMP_NTZ '1969-12-31 23:59:59.5'")).alias("before_epoch"),
    ).first()
    at = datetime(2024, 3, 10, 2, 30, 15)
    assert row.hour == datetime(2024, 3, 10, 2) and row.second == at and row.month == 202403
    assert row.micros == (at - datetime(1970, 1, 1)) // timedelta(microseconds=1) + 123456
    assert row.text == "2024-03-10T02:30:15Z" and row.parsed == at
    assert row.shifted == at + timedelta(hours=5)
    assert row.before_epoch == -500_000


def test_queries_and_storage(spark, zone, event, tmp_path):
    events = event({"created_at": SKIPPED}, {"created_at": "2024-03-10 01:30:00"})
    stats = corpus_stats(events, "2024-03-10 12:00:00").first()
    assert (stats.newest, stats.ingest_lag_seconds) == (datetime(2024, 3, 10, 2, 30), 34_200)
    assert '"created_at":"2024-03-10T02:30:00Z"' in to_bus_messages(events).filter("key = '1'").first().value
    cells = activity_heatmap(activity_weekday_hour(events)).collect()
    assert [(c.weekday, c.hour) for c in cells] == [("sunday", 1), ("sunday", 2)]
    gaps = missing_hours(events, "2024-03-10 00:00:00", "2024-03-10 04:00:00").collect()
    assert [g.hour.hour for g in gaps] == [0, 3]
    path = str(tmp_path / "events")
    write_events(events, path, "a")
    assert read_events(spark, path, SKIPPED).first().created_at == datetime(2024, 3, 10, 2, 30)


def test_admission_window_over_the_clock_change(spark, zone):
    rows = [(1, 1, datetime(2024, 3, 10, 1, 59, 30), 1), (2, 1, datetime(2024, 3, 10, 2, 0, 0), 1)]
    frame = spark.createDataFrame(rows, "request_id BIGINT, key BIGINT, ts TIMESTAMP_NTZ, limit BIGINT")
    result = {r.request_id: (r.admitted, r.retry_after) for r in sliding_window_admission(frame, order="request_id").collect()}
    assert result == {1: (True, 0), 2: (False, 31)}
