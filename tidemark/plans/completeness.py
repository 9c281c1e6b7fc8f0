"""Which hours of a range have no event at all."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_utc, floor_to_hour, hour_of, ts_lit
from tidemark.operators.filters import between, within_months

_HOUR = timedelta(hours=1)


def _distinct_hours(events: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    return within_months(events, start, end).filter(between(start, end)).select(hour_of("created_at").alias("hour")).distinct()


def present_hours(events: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Hours with at least one event in [start, end)."""
    return _distinct_hours(events, start, end).orderBy("hour")


def _expected(start: datetime, end: datetime) -> tuple[datetime, int]:
    first = floor_to_hour(start)
    return first, max(0, (floor_to_hour(end) - first) // _HOUR)


def _missing(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    first, count = _expected(start, end)
    grid = events.sparkSession.range(count).select(
        (ts_lit(first) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("hour")
    )
    # Adaptive execution measures the distinct hours and broadcasts them when they are few.
    return grid.join(_distinct_hours(events, start, end), "hour", "left_anti")


def missing_hours(events: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Hours from floor(start) up to floor(end) without an event in [start, end).

    The events are filtered by the bounds as given, the grid by the floored ones: an hour that `start`
    cuts is missing if all its events lie before `start`.
    """
    return _missing(events, as_utc(start), as_utc(end)).orderBy("hour")


def completeness_summary(events: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Whole hours in `end - start` (not floored, never negative) and the list of missing hours."""
    s, e = as_utc(start), as_utc(end)
    total = max(0, (e - s) // _HOUR)
    # The list is bounded by the asked range, not by the data.
    return _missing(events, s, e).agg(
        F.lit(total).cast("bigint").alias("total_hours"),
        F.count("*").alias("missing_count"),
        F.array_sort(F.collect_list("hour")).alias("missing_hours"),
    )
