"""Roll-ups of the event table: building, merging, storing, reconciling."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_utc, hour_of, iso_weekday, month_number
from tidemark.functions.unsigned import in_order, largest
from tidemark.operators.filters import has_language, is_star, of_month
from tidemark.schema import ACTIVITY, LANGUAGE_DAILY, REPO_STARS_HOURLY, ROLLUP_SCHEMAS
from tidemark.session import run_together
from tidemark.sources.store import (
    LOAD,
    MONTH,
    batch_load,
    finish_replacements,
    fold_loads,
    month_loads,
    read_table,
    replace_loads,
    replace_month,
    write_table,
)

ROLLUP_KEYS = {
    REPO_STARS_HOURLY: ["repo_id", "hour"],
    LANGUAGE_DAILY: ["language", "day"],
    ACTIVITY: ["weekday", "hour"],
}
# The column a partial row's month is read from; the activity key has no date and carries `ym` itself.
_TIME_OF = {REPO_STARS_HOURLY: "hour", LANGUAGE_DAILY: "day"}
_BLOOM = {REPO_STARS_HOURLY: ["repo_id"]}


def repo_stars_hourly(events: DataFrame, *more: str) -> DataFrame:
    """Stars per repository and hour, with the newest name seen in that hour.

    The name is the only string in an aggregation buffer and makes Spark aggregate sorted runs instead of
    a hash table; queries that do not read the name prune it and get the hash form.
    """
    return (
        events.filter(is_star())
        .groupBy("repo_id", hour_of("created_at").alias("hour"), *more)
        .agg(
            F.max_by("repo_name", in_order("event_id")).alias("repo_name"),
            F.count("*").alias("stars"),
            largest("event_id").alias("last_event_id"),
        )
        .select("repo_id", "repo_name", "hour", "stars", "last_event_id", *more)
    )


def language_daily(events: DataFrame, *more: str) -> DataFrame:
    """Events per day and language, over events with a known language."""
    return (
        events.filter(has_language())
        .groupBy(F.to_date("created_at").alias("day"), "language", *more)
        .agg(F.count("*").alias("events"))
    )


def activity_weekday_hour(events: DataFrame, *more: str, by_month: bool = False) -> DataFrame:
    """Events per ISO weekday and hour of day. The key has no date, so the stored form is kept per month."""
    keys = [iso_weekday("created_at").alias("weekday"), F.hour("created_at").alias("hour")]
    if by_month:
        keys.append(month_number("created_at").alias(MONTH))
    return events.groupBy(*keys, *more).agg(F.count("*").alias("events"))


def merge_rollup(partials: DataFrame, keys: list[str], sums: list[str], label: str | None = None) -> DataFrame:
    """Sum the partial rows of each key; with a `label`, keep the one with the highest `last_event_id`."""
    totals = [F.sum(s).alias(s) for s in sums]
    if label is not None:
        totals += [F.max_by(label, in_order("last_event_id")).alias(label), largest("last_event_id").alias("last_event_id")]
    return partials.groupBy(*keys).agg(*totals)


def merge_stored(name: str, partials: DataFrame) -> DataFrame:
    if name == REPO_STARS_HOURLY:
        merged = merge_rollup(partials, ROLLUP_KEYS[name], ["stars"], "repo_name")
    else:
        merged = merge_rollup(partials, ROLLUP_KEYS[name], ["events"])
    return merged.select(*_columns(name))


def _columns(name: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in ROLLUP_SCHEMAS[name].split(",")]


def _build(name: str, events: DataFrame, *more: str) -> DataFrame:
    if name == REPO_STARS_HOURLY:
        return repo_stars_hourly(events, *more)
    if name == LANGUAGE_DAILY:
        return language_daily(events, *more)
    return activity_weekday_hour(events, *more, by_month=True)


def rollup_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_rollups(
    events: DataFrame, root: str, load: str | tuple[str, str], names: list[str] | None = None
) -> None:
    """Add the partial aggregates of some newly stored events, under the name of their load (or the loads
    from..to that their `load` column names).

    Late events simply add to their old hour: nothing is dropped and no watermark is involved.
    """
    by_load = [LOAD] if isinstance(load, tuple) else []

    def write(name: str) -> None:
        rows = _build(name, events, *by_load)
        if name in _TIME_OF:
            rows = rows.withColumn(MONTH, month_number(_TIME_OF[name]))
        write_table(rows, rollup_path(root, name), load, [], ROLLUP_KEYS[name], _BLOOM.get(name))

    run_together(events.sparkSession, *[partial(write, name) for name in names or ROLLUP_SCHEMAS])


def read_rollup(
    spark: SparkSession,
    root: str,
    name: str,
    months: list[int] | None = None,
    start: datetime | str | None = None,
) -> DataFrame:
    """Stored partial rows, several per key; readers merge them. `months` and `start` skip folders."""
    rows = read_table(spark, rollup_path(root, name), ROLLUP_SCHEMAS[name], months)
    if start is not None:
        begin = as_utc(start)
        rows = rows.filter(F.col(MONTH) >= begin.year * 100 + begin.month)
    return rows.select(*_columns(name))


def backfill_rollups(events: DataFrame, root: str, months: list[int], names: list[str] | None = None) -> None:
    """Recompute whole months from the event table; `names` restricts it to some of the roll-ups.

    Events read with `read_table` carry `ym` and `load`: each round then reads one month of folders, and the sums stay under the
    names of the loads they come from, so a batch that runs again afterwards replaces its own part as ever.
    Events without `load` become one load that stands for all the month had; see `replace_month` for replays then. Either
    way running the backfill twice, after a crash or after live ingest, gives the same sums.
    """
    spark = events.sparkSession
    by_load = [LOAD] if LOAD in events.columns else []

    def write(name: str, rows: DataFrame, month: int) -> None:
        path, order, spread = rollup_path(root, name), ROLLUP_KEYS[name], ROLLUP_KEYS[name][:1]
        sums = _build(name, rows, *by_load).select(*_columns(name), *by_load)
        if by_load:
            finish_replacements(spark, path)
            folders = {(month, n) for n in month_loads(spark, path, month)} | {(month, r[0]) for r in loads}
            replace_loads(sums.withColumn(MONTH, F.lit(month)), path, folders, order, spread, _BLOOM.get(name))
        else:
            replace_month(sums, path, month, "backfill", order, spread, _BLOOM.get(name))

    for month in months:
        rows = of_month(events, month)
        loads = rows.select(LOAD).distinct().collect() if by_load else []
        run_together(spark, *[partial(write, name, rows, month) for name in names or ROLLUP_SCHEMAS])


def fold_rollup(spark: SparkSession, root: str, name: str, stream: str, below: int) -> None:
    """Fold the partial rows of a stream's finished batches into one row per key and month."""
    fold_rollup_loads(spark, root, name, batch_load(stream, 0), batch_load(stream, below - 1))


def fold_rollup_loads(spark: SparkSession, root: str, name: str, first: str, last: str) -> None:
    """Fold the partial rows of the loads first..last into one row per key and month."""
    fold_loads(
        spark,
        rollup_path(root, name),
        ROLLUP_SCHEMAS[name],
        first,
        last,
        ROLLUP_KEYS[name],
        ROLLUP_KEYS[name][:1],
        _BLOOM.get(name),
        lambda rows: merge_stored(name, rows),
    )


def reconcile_rollups(events: DataFrame, rollups: dict[str, DataFrame]) -> DataFrame:
    """Totals of the event table beside totals of each roll-up; `difference` must be 0."""
    in_table = events.agg(
        F.count_if(is_star()).alias(REPO_STARS_HOURLY),
        F.count_if(has_language()).alias(LANGUAGE_DAILY),
        F.count("*").alias(ACTIVITY),
    ).select(F.explode(F.create_map(*[e for n in ROLLUP_SCHEMAS for e in (F.lit(n), F.col(n))])).alias("rollup", "n"))
    measure = {REPO_STARS_HOURLY: "stars", LANGUAGE_DAILY: "events", ACTIVITY: "events"}
    parts = [
        rollups[n].agg(F.lit(n).alias("rollup"), F.coalesce(F.sum(measure[n]), F.lit(0)).alias("in_rollup"))
        for n in ROLLUP_SCHEMAS
    ]
    in_rollups = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return in_table.join(in_rollups, "rollup").select(
        "rollup",
        F.col("n").alias("in_events"),
        "in_rollup",
        (F.col("n") - F.col("in_rollup")).alias("difference"),
    )
