"""Most starred repositories of a trailing window, from the roll-up or from raw events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_utc, trending_span
from tidemark.functions.unsigned import in_order
from tidemark.operators.filters import after_keyset, hour_start, is_star, since, since_hour, within_months
from tidemark.operators.rollups import merge_rollup

# --- fixed values of the query contract ---
MAX_LIMIT = 100
DEFAULT_WINDOW = "24h"
DEFAULT_LIMIT = 50
# --- end of fixed values ---


def _check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}, got {limit}")
    return limit


def window_start(as_of: datetime | str, window: str = DEFAULT_WINDOW) -> datetime:
    """First hour a trending window touches; give it to the table readers to skip older months."""
    return hour_start(as_of, trending_span(window))


def _top(totals: DataFrame, limit: int, after: tuple[int, int] | None) -> DataFrame:
    """The first rows in the order stars descending, id ascending: every task keeps `limit` rows."""
    if after is not None:
        totals = totals.filter(after_keyset("stars", "repo_id", after))
    return (
        totals.select("repo_id", "repo_name", "stars")
        .orderBy(F.desc("stars"), in_order("repo_id").asc())
        .limit(_check_limit(limit))
    )


def _star_totals(events: DataFrame, *conditions: Column) -> DataFrame:
    rows = events.filter(is_star())
    for condition in conditions:
        rows = rows.filter(condition)
    return rows.groupBy("repo_id").agg(F.max_by("repo_name", in_order("event_id")).alias("repo_name"), F.count("*").alias("stars"))


def star_totals(rollup: DataFrame, as_of: datetime | str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """All repositories of a trending window with their stars, from the hourly roll-up, in no order."""
    rows = rollup.filter(since_hour(as_of, trending_span(window)))
    return merge_rollup(rows, ["repo_id"], ["stars"], "repo_name").select("repo_id", "repo_name", "stars")


def star_totals_scan(events: DataFrame, as_of: datetime | str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """The same from raw events, with the window aligned like the roll-up."""
    totals = _star_totals(within_months(events, hour_start(as_of, trending_span(window))), since_hour(as_of, trending_span(window), "created_at"))
    return totals.select("repo_id", "repo_name", "stars")


def trending(
    rollup: DataFrame,
    as_of: datetime | str,
    window: str = DEFAULT_WINDOW,
    limit: int = DEFAULT_LIMIT,
    after: tuple[int, int] | None = None,
) -> DataFrame:
    """From the hourly roll-up; the window starts at a full hour."""
    return _top(star_totals(rollup, as_of, window), limit, after)


def trending_scan(
    events: DataFrame,
    as_of: datetime | str,
    window: str = DEFAULT_WINDOW,
    limit: int = DEFAULT_LIMIT,
    after: tuple[int, int] | None = None,
) -> DataFrame:
    """From raw events, window exact to the second."""
    events = within_months(events, as_utc(as_of) - trending_span(window))
    return _top(_star_totals(events, since(as_of, trending_span(window))), limit, after)


def trending_hour_aligned(
    events: DataFrame, as_of: datetime | str, window: str = DEFAULT_WINDOW, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """From raw events, window aligned like the roll-up; must give the same rows as `trending`."""
    return _top(star_totals_scan(events, as_of, window), limit, None)


def trending_by_language(
    events: DataFrame,
    as_of: datetime | str,
    language: str,
    window: str = DEFAULT_WINDOW,
    limit: int = DEFAULT_LIMIT,
    after: tuple[int, int] | None = None,
) -> DataFrame:
    """Restricted to one language. The roll-up has no language, so this reads raw events."""
    events = within_months(events, as_utc(as_of) - trending_span(window))
    totals = _star_totals(events, since(as_of, trending_span(window)), F.col("language") == language)
    return _top(totals, limit, after)


def trending_page(
    as_of: datetime | str,
    *,
    rollup: DataFrame | None = None,
    events: DataFrame | None = None,
    window: str = DEFAULT_WINDOW,
    language: str | None = None,
    limit: int = DEFAULT_LIMIT,
    after: tuple[int, int, int] | None = None,
) -> DataFrame:
    """One page with ranks. `after` is (stars, repo_id, rank) of the last row of the page before.

    Without a language the roll-up answers, with one the raw events do. `has_next` is true on every row
    of a full page. The ranking window sees at most `limit` rows, because it stands after the limit.
    """
    keyset, start = (after[:2], after[2]) if after is not None else (None, 0)
    if language:
        page = trending_by_language(events, as_of, language, window, limit, keyset)
    else:
        page = trending(rollup, as_of, window, limit, keyset)
    whole = Window.partitionBy(F.lit(1))
    ranked = F.row_number().over(whole.orderBy(F.desc("stars"), in_order("repo_id").asc()))
    return page.select(
        "repo_id",
        "repo_name",
        "stars",
        (ranked + F.lit(start)).cast("bigint").alias("rank"),
        (F.count("*").over(whole) == limit).alias("has_next"),
    )
