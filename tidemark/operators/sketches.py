"""Roll-ups of mergeable sketches per day: distinct repositories and actors, payload sizes, frequent keys.

Like the other roll-ups they are kept as partial rows under the names of their loads, so a batch that runs again replaces its
own part, and readers merge what they need: a question about a year reads days, not events. Counts, minima and
maxima beside the sketches are exact.
"""

from __future__ import annotations

from datetime import datetime
from functools import partial
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_utc, month_number, seconds_of, ts_lit
from tidemark.functions.unsigned import in_order
from tidemark.operators.profiles import format_epoch
from tidemark.plans.corpus import SKETCH_LOG2
from tidemark.session import run_together
from tidemark.sources.store import LOAD, MONTH, batch_load, fold_loads, read_table, write_table

CORPUS_DAILY = "corpus_daily"
PAYLOAD_DAILY = "payload_daily"
KEYS_DAILY = "keys_daily"

# State of `approx_top_k_accumulate` over a BIGINT column, as the engine writes it.
_STATE = "STRUCT<sketch: BINARY, maxItemsTracked: INT, itemDataType: BIGINT, itemDataTypeDDL: STRING>"
SKETCH_SCHEMAS = {
    CORPUS_DAILY: "day DATE, events BIGINT, oldest TIMESTAMP_NTZ, newest TIMESTAMP_NTZ, repos BINARY, actors BINARY",
    PAYLOAD_DAILY: "day DATE, event_type STRING, epoch STRING, events BIGINT, min_size BIGINT, max_size BIGINT, sizes BINARY",
    KEYS_DAILY: f"day DATE, key STRING, events BIGINT, frequent {_STATE}",
}
_COLUMNS = {
    CORPUS_DAILY: ["day", "events", "oldest", "newest", "repos", "actors"],
    PAYLOAD_DAILY: ["day", "event_type", "epoch", "events", "min_size", "max_size", "sizes"],
    KEYS_DAILY: ["day", "key", "events", "frequent"],
}
_KEYS = {CORPUS_DAILY: ["day"], PAYLOAD_DAILY: ["day", "event_type", "epoch"], KEYS_DAILY: ["day", "key"]}

# Ranks are right within about 1.65 % at k = 200, and the error falls with 1 / k.
KLL_K = 400
KLL_RANK_ERROR = 0.01

FREQUENT_KEYS = ["repo_id", "actor_id"]
TRACKED = 3_000


def frequency_error(tracked: int) -> float:
    """Most by which a frequent-items estimate exceeds the true count, as a share of all rows.

    The summary has room for the next power of two above tracked / 0.75 items and loses at most 3.5 rows in that many.
    """
    return 3.5 / 2 ** ceil(log2(tracked / 0.75))


def _frequent(key: str, tracked: int) -> Column:
    return F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})")


def _day() -> Column:
    return F.to_date("created_at").alias("day")


def corpus_daily(events: DataFrame, *more: str) -> DataFrame:
    """Per day: events, first and last time, sketches of repositories and actors."""
    return events.groupBy(_day(), *more).agg(
        F.count("*").alias("events"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.hll_sketch_agg("repo_id", SKETCH_LOG2).alias("repos"),
        F.hll_sketch_agg("actor_id", SKETCH_LOG2).alias("actors"),
    )


def payload_daily(events: DataFrame, *more: str) -> DataFrame:
    """Per day, type and payload format: events, smallest and largest payload, sketch of the sizes."""
    return events.groupBy(_day(), "event_type", format_epoch().alias("epoch"), *more).agg(
        F.count("*").alias("events"),
        F.min("payload_size").alias("min_size"),
        F.max("payload_size").alias("max_size"),
        F.kll_sketch_agg_bigint("payload_size", KLL_K).alias("sizes"),
    )


def keys_daily(events: DataFrame, *more: str) -> DataFrame:
    """Per day and key column: events and a summary of the most frequent values."""
    wide = events.groupBy(_day(), *more).agg(F.count("*").alias("events"), *[_frequent(k, TRACKED).alias(k) for k in FREQUENT_KEYS])
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("frequent")) for k in FREQUENT_KEYS]))
    return wide.select("day", "events", *more, pairs)


_BUILD = {CORPUS_DAILY: corpus_daily, PAYLOAD_DAILY: payload_daily, KEYS_DAILY: keys_daily}
_MERGE = {
    CORPUS_DAILY: lambda: [
        F.sum("events").alias("events"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        F.hll_union_agg("repos").alias("repos"),
        F.hll_union_agg("actors").alias("actors"),
    ],
    PAYLOAD_DAILY: lambda: [
        F.sum("events").alias("events"),
        F.min("min_size").alias("min_size"),
        F.max("max_size").alias("max_size"),
        F.kll_merge_agg_bigint("sizes").alias("sizes"),
    ],
    KEYS_DAILY: lambda: [F.sum("events").alias("events"), F.expr("approx_top_k_combine(frequent)").alias("frequent")],
}


def merge_sketches(name: str, partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key of the roll-up, or per the `keys` given: none for all there is."""
    return partials.groupBy(*(_KEYS[name] if keys is None else keys)).agg(*_MERGE[name]())


def sketch_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_sketches(events: DataFrame, root: str, load: str | tuple[str, str], names: list[str] | None = None) -> None:
    """Add the sketches of some newly stored events under the name of their load (see `rollups.write_rollups`)."""
    by_load = [LOAD] if isinstance(load, tuple) else []

    def write(name: str) -> None:
        rows = _BUILD[name](events, *by_load).select(*_COLUMNS[name], *by_load)
        write_table(rows.withColumn(MONTH, month_number("day")), sketch_path(root, name), load, [], _KEYS[name])

    run_together(events.sparkSession, *[partial(write, name) for name in names or SKETCH_SCHEMAS])


def read_sketches(
    spark: SparkSession, root: str, name: str, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """Stored partial rows of the days [start, end), several per key; months outside are not read."""
    rows = read_table(spark, sketch_path(root, name), SKETCH_SCHEMAS[name])
    if start is not None:
        first = as_utc(start)
        rows = rows.filter((F.col(MONTH) >= first.year * 100 + first.month) & (F.col("day") >= F.lit(first.date())))
    if end is not None:
        last = as_utc(end)
        rows = rows.filter((F.col(MONTH) <= last.year * 100 + last.month) & (F.col("day") < F.lit(last.date())))
    return rows.select(*_COLUMNS[name])


def fold_sketches(spark: SparkSession, root: str, name: str, stream: str, below: int) -> None:
    """Fold the partial rows of a stream's finished batches into one row per key and month."""
    fold_loads(
        spark,
        sketch_path(root, name),
        SKETCH_SCHEMAS[name],
        batch_load(stream, 0),
        batch_load(stream, below - 1),
        _KEYS[name],
        [],
        None,
        lambda rows: merge_sketches(name, rows).select(*_COLUMNS[name]),
    )


# Questions ---------------------------------------------------------------------------------------------------


def corpus_from_sketches(days: DataFrame, as_of: datetime | str) -> DataFrame:
    """`corpus_stats` from `corpus_daily` rows; counts of distinct ids have a standard error of about 0.7 %."""

    def about(column: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(column), F.lit(0).cast("bigint"))

    return merge_sketches(CORPUS_DAILY, days, []).select(
        F.coalesce("events", F.lit(0).cast("bigint")).alias("events_total"),
        "oldest",
        "newest",
        (seconds_of(ts_lit(as_of)) - seconds_of("newest")).alias("ingest_lag_seconds"),
        about("repos").alias("distinct_repos"),
        about("actors").alias("distinct_actors"),
    )


def sizes_from_sketches(days: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per type and payload format: events, exact extremes, and sizes at the given ranks (within KLL_RANK_ERROR of them)."""
    merged = merge_sketches(PAYLOAD_DAILY, days, ["event_type", "epoch"])
    found = [F.kll_sketch_get_quantile_bigint("sizes", F.lit(rank)).alias(f"p{rank * 100:g}".replace(".", "_")) for rank in ranks]
    return merged.select("event_type", "epoch", "events", "min_size", "max_size", *found)


def _estimates(days: DataFrame, key: str, most: int) -> DataFrame:
    """(events, id, upper): the values with the largest estimates, which are upper bounds of their counts."""
    merged = merge_sketches(KEYS_DAILY, days.filter(F.col("key") == key), ["key"])  # no row for no days
    found = F.expr(f"approx_top_k_estimate(frequent, {most})")
    return merged.select("events", F.inline_outer(found).alias("id", "upper"))


def key_bounds(days: DataFrame, key: str, tracked: int = TRACKED) -> DataFrame:
    """One row: how often the most frequent value of a key occurs at least and at most; no row without events.

    An estimate exceeds the count by at most the summary's error, and a value that is not among them occurs at most that often.
    """
    error = F.ceil(F.col("events") * F.lit(frequency_error(tracked))).cast("bigint")
    largest = _estimates(days, key, 1).groupBy("events").agg(F.coalesce(F.max("upper"), F.lit(0)).alias("upper"))
    return largest.select(
        F.lit(key).alias("key"),
        "events",
        F.greatest(F.col("upper") - error, F.lit(1)).alias("largest_least"),
        F.greatest(F.col("upper"), error).alias("largest_most"),
    )


def heavy_keys(events: DataFrame, days: DataFrame, key: str, share: float, tracked: int = TRACKED) -> DataFrame:
    """Values that make up at least `share` of all events, with their exact counts, most frequent first.

    The sketches of `days`, which must cover `events`, name every value that can reach the share; only those are then counted, so no
    shuffle sees the others. The share must exceed the summary's error.
    """
    if share <= frequency_error(tracked):
        raise ValueError(f"a summary of {tracked} values finds shares above {frequency_error(tracked):.4f}")
    possible = _estimates(days, key, tracked).filter(F.col("upper") >= F.col("events") * share).select("id", F.col("events").alias("_all"))
    counted = events.join(possible, events[key] == possible["id"]).groupBy("id").agg(F.count("*").alias("n"), F.max("_all").alias("_all"))
    heavy = counted.filter(F.col("n") >= F.col("_all") * share).select(F.col("id").alias(key), "n", (F.col("n") / F.col("_all")).alias("share"))
    return heavy.orderBy(F.desc("n"), in_order(key).asc())
