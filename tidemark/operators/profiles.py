"""Data-quality reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_utc, floor_to_hour, hour_of, ts_lit
from tidemark.functions.unsigned import largest
from tidemark.operators.filters import between, has_language
from tidemark.plans.corpus import about_distinct
from tidemark.schema import ID_COLUMNS

# --- fixed values of the event feed: the payload format changed between these two hours ---
OLD_FORMAT_LAST_SEEN = "2025-10-01 15:00:00"
NEW_FORMAT_FIRST_SEEN = "2025-10-15 15:00:00"
# --- end of fixed values ---

KEY_CANDIDATES = ["event_id", "repo_id", "actor_id", "event_type"]
CONTROL_KEY = "constant"


def event_type_mix(events: DataFrame, hour: datetime | str | None = None) -> DataFrame:
    """Count and share of every event type, most frequent first; optionally within one hour."""
    if hour is not None:
        begin = floor_to_hour(as_utc(hour))
        events = events.filter(between(begin, begin + timedelta(hours=1)))
    counts = events.groupBy("event_type").agg(F.count("*").alias("events"))
    # One row per event type reaches this window.
    total = F.sum("events").over(Window.partitionBy(F.lit(1)))
    return counts.select("event_type", "events", (F.col("events") / total).alias("share")).orderBy(
        F.desc("events"), "event_type"
    )


def _per_value(events: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(key, value, n) for several columns in one scan: each row gives one narrow pair per column, counted
    before the shuffle."""
    pairs = [F.struct(F.lit(name).alias("key"), c.cast("string").alias("value")) for name, c in columns.items()]
    return events.select(F.inline(F.array(*pairs))).groupBy("key", "value").agg(F.count("*").alias("n"))


def _frequencies(per_value: DataFrame, *more: Column) -> DataFrame:
    return per_value.groupBy("key").agg(
        F.count("*").alias("distinct_keys"),
        F.max("n").alias("largest"),
        (F.max("n") / F.sum("n")).alias("largest_share"),
        *more,
    )


def key_frequency(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per candidate key: distinct values, rows of the largest value and its share of all rows."""
    return _frequencies(_per_value(events, {k: F.col(k) for k in keys or KEY_CANDIDATES}))


def key_skew(
    events: DataFrame,
    keys: list[str] | None = None,
    partitions: int = 6,
    hash_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """`key_frequency` plus the skew (largest over mean load) of hash partitioning by that key.

    The constant key is the control: all rows in one partition, skew = number of partitions. Counting per
    value first means the hash is taken once per distinct value and nothing is shuffled unaggregated.
    """
    columns = {k: F.col(k) for k in keys or KEY_CANDIDATES} | {CONTROL_KEY: F.lit(CONTROL_KEY)}
    bucket = F.pmod(hash_of(F.col("value")), F.lit(partitions))
    loads = [F.coalesce(F.sum(F.when(bucket == i, F.col("n"))), F.lit(0)) for i in range(partitions)]
    largest_load = F.greatest(*loads) if partitions > 1 else loads[0]
    return _frequencies(
        _per_value(events, columns), (largest_load * F.lit(partitions) / F.sum("n")).alias("partition_skew")
    )


def format_epoch(created_at: str = "created_at") -> Column:
    """Payload format by time: 'old', 'new', or 'unclear' between the last old and the first new hour."""
    return (
        F.when(hour_of(created_at) <= ts_lit(OLD_FORMAT_LAST_SEEN), "old")
        .when(hour_of(created_at) >= ts_lit(NEW_FORMAT_FIRST_SEEN), "new")
        .otherwise("unclear")
    )


def payload_size_profile(events: DataFrame) -> DataFrame:
    """Median, smallest and largest payload by event type and format epoch.

    Rows are first counted per distinct size; the exact median then weighs sizes by their counts, so its
    state is the set of distinct sizes of a group and not the rows of a group.
    """
    sized = events.groupBy("event_type", format_epoch().alias("epoch"), "payload_size").agg(F.count("*").alias("n"))
    return sized.groupBy("event_type", "epoch").agg(
        F.sum("n").alias("events"),
        F.percentile("payload_size", 0.5, F.col("n")).alias("median_size"),
        F.min("payload_size").alias("min_size"),
        F.max("payload_size").alias("max_size"),
    )


PROFILED = ["event_type", "actor_id", "actor_login", "repo_id", "repo_name", "org_id", "language"]


def _most(column: str) -> Column:
    return largest(column) if column in ID_COLUMNS else F.max(column)


def column_profile(events: DataFrame, exact: bool = False) -> DataFrame:
    """One row: distinct values per column, largest ids, share of events with organisation and language."""
    share = {"org_share": F.col("org_id") != 0, "language_share": has_language()}
    base = [
        F.count("*").alias("events"),
        *[_most(c).alias(f"max_{c}") for c in (*ID_COLUMNS, "payload_size")],
        *[F.try_divide(F.count_if(cond), F.count("*")).alias(name) for name, cond in share.items()],
    ]
    if exact:
        # One scan: the profiled columns as pairs, the other figures as sums and maxima of the same rows.
        figures = events.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in PROFILED])),
            *[F.col(c) for c in (*ID_COLUMNS, "payload_size")],
            *[cond.cast("int").alias(name) for name, cond in share.items()],
        )
        ids = (*ID_COLUMNS, "payload_size")
        per_value = figures.groupBy("key", "value").agg(
            F.count("*").alias("n"), *[_most(c).alias(c) for c in ids], *[F.sum(s).alias(s) for s in share]
        )
        first = F.col("key") == PROFILED[0]  # every event is counted once per profiled column
        return per_value.agg(
            F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias("events"),
            *[_most(c).alias(f"max_{c}") for c in ids],
            *[F.try_divide(F.sum(F.when(first, F.col(s))), F.sum(F.when(first, F.col("n")))).alias(s) for s in share],
            *[F.count_if((F.col("key") == c) & F.col("value").isNotNull()).alias(f"distinct_{c}") for c in PROFILED],
        )
    return events.agg(*base, *[about_distinct(c).alias(f"distinct_{c}") for c in PROFILED])


def ref_form_profile(events: DataFrame) -> DataFrame:
    """Per event type: fully qualified refs, bare refs, events without a ref."""
    # --- fixed values of the event feed ---
    qualified = F.col("ref").startswith("refs/")
    # --- end of fixed values ---
    return events.groupBy("event_type").agg(
        F.count_if(qualified).alias("qualified"),
        F.count_if((F.col("ref") != "") & ~qualified).alias("bare"),
        F.count_if(F.col("ref") == "").alias("without_ref"),
    )
