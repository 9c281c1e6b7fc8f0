"""Reconciling roll-ups with events month by month, reading only what differs.

Every load writes additive fingerprints of its events beside them: for each roll-up and month the number of events that belong
in it, and the sum of a hash of the key that each of them counts for. A roll-up row that counts n events for a key adds n
times the same hash, so right roll-ups have the sums of their events, whatever the loads. Comparing the sums reads
the fingerprints and the roll-ups; events are read for months whose sums differ, and there by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import hour_of, iso_weekday, month_number
from tidemark.operators.filters import has_language, is_star
from tidemark.operators.rollups import ROLLUP_KEYS, rollup_path
from tidemark.schema import ACTIVITY, LANGUAGE_DAILY, REPO_STARS_HOURLY, ROLLUP_SCHEMAS
from tidemark.sources.store import (
    EVENTS_DDL,
    LOAD,
    MONTH,
    batch_load,
    fold_loads,
    read_table,
    replace_loads,
    write_table,
)

FINGERPRINTS = "rollup STRING, n BIGINT, hash_sum DECIMAL(38,0)"
_MEASURE = {REPO_STARS_HOURLY: "stars", LANGUAGE_DAILY: "events", ACTIVITY: "events"}


def _belongs(name: str) -> Column:
    return {REPO_STARS_HOURLY: is_star(), LANGUAGE_DAILY: has_language(), ACTIVITY: F.lit(True)}[name]


def _event_keys(name: str) -> list[Column]:
    """The roll-up's key columns of an event, named as in the roll-up."""
    keys = {
        REPO_STARS_HOURLY: [F.col("repo_id"), hour_of("created_at")],
        LANGUAGE_DAILY: [F.col("language"), F.to_date("created_at")],
        ACTIVITY: [iso_weekday("created_at"), F.hour("created_at")],
    }[name]
    return [key.alias(c) for key, c in zip(keys, ROLLUP_KEYS[name], strict=True)]


def _hash(columns: list[Column]) -> Column:
    return F.xxhash64(*columns).cast("decimal(38,0)")


def event_fingerprints(events: DataFrame, *more: str) -> DataFrame:
    """(ym, rollup, n, hash_sum) of events, one pass and one row per month and roll-up."""
    month = F.col(MONTH) if MONTH in events.columns else month_number("created_at")
    sums = []
    for name in ROLLUP_SCHEMAS:
        sums.append(F.count_if(_belongs(name)).alias(f"{name}_n"))
        sums.append(F.sum(F.when(_belongs(name), _hash(_event_keys(name)))).alias(f"{name}_h"))
    wide = events.groupBy(month.alias(MONTH), *more).agg(*sums)
    rows = [
        F.struct(F.lit(n).alias("rollup"), F.col(f"{n}_n").alias("n"), F.coalesce(f"{n}_h", F.lit(0)).cast("decimal(38,0)").alias("hash_sum"))
        for n in ROLLUP_SCHEMAS
    ]
    return wide.select(MONTH, *more, F.inline(F.array(*rows)))


def write_fingerprints(events: DataFrame, path: str, load: str | tuple[str, str]) -> None:
    """Keep the fingerprints of newly stored events under the name of their load (or the loads their `load` column names)."""
    by_load = [LOAD] if isinstance(load, tuple) else []
    write_table(event_fingerprints(events, *by_load), path, load, [], ["rollup"])


def rewrite_fingerprints(stored: DataFrame, path: str, folders: list[tuple[int, str]]) -> None:
    """Bring the fingerprints of loads whose stored events (with `ym` and `load`) have changed up to date."""
    replace_loads(event_fingerprints(stored, LOAD), path, folders, ["rollup"], [])


def fold_fingerprints(spark: SparkSession, path: str, stream: str, below: int) -> None:
    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("rollup").agg(F.sum("n").alias("n"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"))

    fold_loads(spark, path, FINGERPRINTS, batch_load(stream, 0), batch_load(stream, below - 1), ["rollup"], [], None, summed)


def rollup_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(ym, rollup, n, hash_sum) of the stored roll-ups."""
    parts = []
    for name in ROLLUP_SCHEMAS:
        rows = read_table(spark, rollup_path(root, name), ROLLUP_SCHEMAS[name])
        weight = F.col(_MEASURE[name]).cast("decimal(19,0)")
        keys = [F.col(c) for c in ROLLUP_KEYS[name]]
        parts.append(
            rows.groupBy(MONTH).agg(
                F.lit(name).alias("rollup"),
                F.sum(_MEASURE[name]).alias("n"),
                F.sum((weight * F.xxhash64(*keys).cast("decimal(19,0)")).cast("decimal(38,0)")).alias("hash_sum"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def differing_months(spark: SparkSession, fingerprints: str, rollups: str) -> DataFrame:
    """(rollup, ym, in_events, in_rollup) of the months whose sums differ; counts may be equal where keys are not."""
    kept = read_table(spark, fingerprints, FINGERPRINTS).groupBy("rollup", MONTH).agg(F.sum("n").alias("n"), F.sum("hash_sum").alias("h"))
    stored = rollup_fingerprints(spark, rollups).select("rollup", MONTH, F.col("n").alias("m"), F.col("hash_sum").alias("g"))
    zero = F.lit(0).cast("decimal(38,0)")
    both = kept.join(stored, ["rollup", MONTH], "full")
    differ = (F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0))) | (F.coalesce("h", zero) != F.coalesce("g", zero))
    return both.filter(differ).select(
        "rollup", MONTH, F.coalesce("n", F.lit(0)).alias("in_events"), F.coalesce("m", F.lit(0)).alias("in_rollup")
    )


def key_differences(spark: SparkSession, events: str, rollups: str, name: str, months: list[int]) -> DataFrame:
    """(rollup, ym, key, in_events, in_rollup) of the keys that differ in some months; only these months are read."""
    counted = (
        read_table(spark, events, EVENTS_DDL, months).filter(_belongs(name)).groupBy(MONTH, *_event_keys(name)).agg(F.count("*").alias("in_events"))
    )
    stored = (
        read_table(spark, rollup_path(rollups, name), ROLLUP_SCHEMAS[name], months)
        .groupBy(MONTH, *ROLLUP_KEYS[name])
        .agg(F.sum(_MEASURE[name]).alias("in_rollup"))
    )
    both = counted.join(stored, [MONTH, *ROLLUP_KEYS[name]], "full").fillna(0, ["in_events", "in_rollup"])
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ROLLUP_KEYS[name]])
    return both.filter("in_events <> in_rollup").select(F.lit(name).alias("rollup"), MONTH, key.alias("key"), "in_events", "in_rollup")


def reconcile_months(spark: SparkSession, events: str, fingerprints: str, rollups: str) -> DataFrame:
    """All keys of all roll-ups that do not agree with the stored events; the driver holds one row per differing month."""
    months: dict[str, list[int]] = {}
    for row in differing_months(spark, fingerprints, rollups).collect():
        months.setdefault(row["rollup"], []).append(row[MONTH])
    found = spark.createDataFrame([], f"rollup STRING, {MONTH} INT, key STRING, in_events BIGINT, in_rollup BIGINT")
    for name, own in sorted(months.items()):
        found = found.unionByName(key_differences(spark, events, rollups, name, own))
    return found
