"""Row predicates shared by the queries. All bounds are literals computed once on the driver, so they
reach the Parquet scan as plain comparisons."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_utc, date_lit, floor_to_hour, ts_lit
from tidemark.functions.unsigned import as_bits, in_order
from tidemark.schema import STAR


def is_star() -> Column:
    return F.col("event_type") == STAR


def hour_start(as_of: datetime | str, span: timedelta) -> datetime:
    return floor_to_hour(as_utc(as_of) - span)


def within_months(rows: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Skip the month folders outside [start, end) where the frame still has its month column.

    Spark cannot derive a folder from a bound on `created_at`; queries that bound the time call this too.
    """
    if "ym" not in rows.columns:
        return rows
    if start is not None:
        rows = rows.filter(F.col("ym") >= as_utc(start).year * 100 + as_utc(start).month)
    if end is not None:
        rows = rows.filter(F.col("ym") <= as_utc(end).year * 100 + as_utc(end).month)
    return rows


def since(as_of: datetime | str, span: timedelta, column: str = "created_at") -> Column:
    """Trailing window, exact to the second, open to the right."""
    return F.col(column) >= ts_lit(as_utc(as_of) - span)


def since_hour(as_of: datetime | str, span: timedelta, column: str = "hour") -> Column:
    """Trailing window that starts at the full hour."""
    return F.col(column) >= ts_lit(hour_start(as_of, span))


def since_day(as_of: datetime | str, days: int, column: str = "day") -> Column:
    """Trailing window over a DATE column that starts at the full day."""
    return F.col(column) >= date_lit((as_utc(as_of) - timedelta(days=days)).date())


def between(start: datetime | str, end: datetime | str, column: str = "created_at") -> Column:
    """Half-open range; bounds without an offset are UTC."""
    return (F.col(column) >= ts_lit(start)) & (F.col(column) < ts_lit(end))


def has_language() -> Column:
    return F.col("language") != ""


def in_month(month: int, column: str = "created_at") -> Column:
    """Month predicate on a frame without a month column, written as a range so it can be pushed down."""
    year, number = divmod(month, 100)
    following = datetime(year + number // 12, number % 12 + 1, 1)
    return between(datetime(year, number, 1), following, column)


def of_month(rows: DataFrame, month: int) -> DataFrame:
    """Rows of one month; uses the partition column where the frame has it."""
    return rows.filter((F.col("ym") == month) if "ym" in rows.columns else in_month(month))


def after_keyset(total: str, tie: str, after: tuple[int, int]) -> Column:
    """Rows that follow (total, tie) in the order total descending, tie (an unsigned id) ascending."""
    last_total, last_tie = after
    later = in_order(tie) > in_order(F.lit(as_bits(last_tie)).cast("bigint"))
    return (F.col(total) < last_total) | ((F.col(total) == last_total) & later)

