"""Language series over the enriched part of the events, and how large that part is."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_utc, trend_days
from tidemark.operators.filters import has_language, since, since_day, within_months
from tidemark.operators.rollups import merge_rollup

DEFAULT_WINDOW = "30d"


def language_coverage(events: DataFrame, as_of: datetime | str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Events with a known language, all events, and their ratio (0.0 without events)."""
    span = timedelta(days=trend_days(window))
    counted = within_months(events, as_utc(as_of) - span).filter(since(as_of, span)).agg(
        F.count_if(has_language()).alias("known"), F.count("*").alias("total")
    )
    ratio = F.when(F.col("total") > 0, F.col("known") / F.col("total")).otherwise(0.0)
    return counted.select("known", "total", ratio.alias("coverage"))


def _merged(rollup: DataFrame, as_of: datetime | str, window: str) -> DataFrame:
    rows = rollup.filter(since_day(as_of, trend_days(window)))
    return merge_rollup(rows, ["language", "day"], ["events"])


def language_trends(rollup: DataFrame, as_of: datetime | str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Events per language and day, ordered by both."""
    return (
        _merged(rollup, as_of, window)
        .select("language", F.col("day").alias("date"), "events")
        .orderBy("language", "date")
    )


def language_series(rollup: DataFrame, as_of: datetime | str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """One row per language with its points in date order; at most one point per day of the window."""
    points = F.array_sort(F.collect_list(F.struct(F.col("day").alias("date"), "events")))
    return _merged(rollup, as_of, window).groupBy("language").agg(points.alias("points")).orderBy("language")
