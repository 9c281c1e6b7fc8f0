"""Time expressions on TIMESTAMP_NTZ columns; none of them looks at the session time zone."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"

# --- fixed values of the queries: windows a caller may ask for, names of the weekdays ---
TRENDING_WINDOWS = {"1h": timedelta(hours=1), "24h": timedelta(hours=24), "7d": timedelta(days=7)}
TREND_DAYS = {"7d": 7, "30d": 30, "90d": 90}

# ISO order: element 1 is Monday.
WEEKDAY_NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# --- end of fixed values ---

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def as_utc(moment: datetime | str) -> datetime:
    """Naive UTC wall clock of `moment`; a value without an offset is taken as UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is not None:
        moment = moment.astimezone(UTC).replace(tzinfo=None)
    return moment


def ts_lit(moment: datetime | str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_utc(moment):%Y-%m-%d %H:%M:%S.%f}'")


def date_lit(day: date) -> Column:
    return F.expr(f"DATE '{day:%Y-%m-%d}'")


def floor_to_hour(moment: datetime) -> datetime:
    return moment.replace(minute=0, second=0, microsecond=0)


def trending_span(window: str) -> timedelta:
    if window not in TRENDING_WINDOWS:
        raise ValueError(f"window must be one of {sorted(TRENDING_WINDOWS)}, got {window!r}")
    return TRENDING_WINDOWS[window]


def trend_days(window: str) -> int:
    if window not in TREND_DAYS:
        raise ValueError(f"window must be one of {sorted(TREND_DAYS)}, got {window!r}")
    return TREND_DAYS[window]


def hour_of(ts: Column | str) -> Column:
    """Start of the hour. `date_trunc` would go through the session zone, this does not."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def second_of(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.hour(ts), F.minute(ts), F.second(ts).cast("decimal(8,6)")
    )


def month_number(ts: Column | str) -> Column:
    """YYYYMM as INT, the partition key of every table."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def months_between(start: datetime, end: datetime) -> list[int]:
    """Partition keys touched by the half-open range."""
    if end <= start:
        return []
    last = end - timedelta(microseconds=1)
    count = (last.year - start.year) * 12 + last.month - start.month + 1
    first = start.year * 12 + start.month - 1
    return [(first + i) // 12 * 100 + (first + i) % 12 + 1 for i in range(count)]


def iso_weekday(ts: Column | str) -> Column:
    return (F.weekday(ts) + 1).cast("int")


def weekday_name(weekday: Column | str) -> Column:
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.element_at(names, F.col(weekday) if isinstance(weekday, str) else weekday)


def seconds_of(ts: Column | str) -> Column:
    """Whole seconds since 1970. The difference functions of Spark would go through the session zone and
    be an hour off where that zone changes its clocks."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    in_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86_400 + in_day


def micros_of(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    fraction = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint") - F.second(ts) * 1_000_000
    return seconds_of(ts) * 1_000_000 + fraction


def utc_now() -> Column:
    return F.timestamp_add("SECOND", F.unix_seconds(F.current_timestamp()), F.expr(EPOCH))


def parse_rfc3339(text: Column) -> Column:
    """UTC wall clock, cut to seconds; NULL for anything that is not a full RFC 3339 timestamp."""
    instant = F.try_to_timestamp(F.when(text.rlike(_RFC3339), text))
    return F.timestamp_add("SECOND", F.unix_seconds(instant), F.expr(EPOCH))


def to_rfc3339(ts: Column | str) -> Column:
    """Text of a whole-second UTC time; formatting functions would go through the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.translate(ts.cast("string"), " ", "T"), F.lit("Z"))
