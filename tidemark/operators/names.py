"""Which repository had which name when: a roll-up per name, id and month, kept per load like the others.

Repositories are renamed, and a name that is free can be taken by another one. Partial rows hold what a repository card needs
to know of a name (counts, newest event), so a card reads rows of one name, found by Bloom filter, instead of all
events of that name; the same rows give the history of names as periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import month_number
from tidemark.functions.unsigned import in_order, largest
from tidemark.schema import FORK, ISSUES, PUSH
from tidemark.sources.store import LOAD, MONTH, batch_load, fold_loads, read_table, write_table

# `first_event` and `last_event` are event ids, `since` and `until` the times of the first and last event under the name.
NAMES = (
    "repo_name STRING, repo_id BIGINT, events BIGINT, pushes BIGINT, forks BIGINT, issues BIGINT, "
    "last_event BIGINT, since TIMESTAMP_NTZ, until TIMESTAMP_NTZ"
)
_KEY = ["repo_name", "repo_id"]
_COLUMNS = ["repo_name", "repo_id", "events", "pushes", "forks", "issues", "last_event", "since", "until"]
_BLOOM = ["repo_name", "repo_id"]


def names_monthly(events: DataFrame, *more: str) -> DataFrame:
    """Per name, id and month: events by type, newest event, first and last time."""
    return events.groupBy(*_KEY, month_number("created_at").alias(MONTH), *more).agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col("event_type") == t).alias(c) for c, t in (("pushes", PUSH), ("forks", FORK), ("issues", ISSUES))],
        largest("event_id").alias("last_event"),
        F.min("created_at").alias("since"),
        F.max("created_at").alias("until"),
    )


def merge_names(partials: DataFrame) -> DataFrame:
    """One row per name and id."""
    sums = [F.sum(c).alias(c) for c in ("events", "pushes", "forks", "issues")]
    return partials.groupBy(*_KEY).agg(
        *sums, largest("last_event").alias("last_event"), F.min("since").alias("since"), F.max("until").alias("until")
    )


def write_names(events: DataFrame, path: str, load: str | tuple[str, str]) -> None:
    """Add the names of some newly stored events under the name of their load (see `rollups.write_rollups`)."""
    by_load = [LOAD] if isinstance(load, tuple) else []
    write_table(names_monthly(events, *by_load).select(*_COLUMNS, MONTH, *by_load), path, load, [], _KEY, _BLOOM)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, NAMES).select(*_COLUMNS)


def fold_names(spark: SparkSession, path: str, stream: str, below: int) -> None:
    """Fold the partial rows of a stream's finished batches into one row per name, id and month."""
    first, last = batch_load(stream, 0), batch_load(stream, below - 1)
    fold_loads(spark, path, NAMES, first, last, _KEY, [], _BLOOM, lambda rows: merge_names(rows).select(*_COLUMNS))


def lookup_from_names(names: DataFrame, repo_name: str) -> DataFrame:
    """`cards.repo_lookup` from stored names: newest id under this name and its counts by name, 0 events if unknown."""
    own = names.filter(F.col("repo_name") == repo_name)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", "pushes", "forks", "issues")]
    return own.agg(F.max_by("repo_id", in_order("last_event")).alias("repo_id"), *sums).withColumnRenamed("events", "total_events")


def name_history(names: DataFrame) -> DataFrame:
    """Periods in which a repository went by a name: repo_id, repo_name, valid_from, valid_to (null: still), events.

    A period begins with the first event of the repository under the name, and ends when the first event under its next name
    or of another repository under the same name comes, whichever is earlier. A repository that comes back to an old name
    has one period for it, from its first to its last use.
    """
    merged = merge_names(names)
    by_id = Window.partitionBy("repo_id").orderBy("since", "repo_name")
    by_name = Window.partitionBy("repo_name").orderBy("since", in_order("repo_id"))
    ends = F.least(F.lead("since").over(by_id), F.lead("since").over(by_name))
    later = F.when(F.col("until") > ends, F.col("until")).otherwise(ends)  # it came back, or both used it for a while
    return merged.withColumn("valid_to", F.when(ends.isNotNull(), later)).select(
        "repo_id", "repo_name", F.col("since").alias("valid_from"), "valid_to", "events"
    )


def current_names(names: DataFrame) -> DataFrame:
    """(repo_id, repo_name): the name of each repository's newest event."""
    return names.groupBy("repo_id").agg(F.max_by("repo_name", in_order("last_event")).alias("repo_name"))


def follow_name(names: DataFrame, repo_name: str) -> DataFrame:
    """(asked, repo_id, repo_name): every repository that ever had this name, with the name it has now, newest use first."""
    asked = merge_names(names.filter(F.col("repo_name") == repo_name)).select("repo_id", "last_event")
    now = current_names(names.join(asked.select("repo_id"), "repo_id", "left_semi"))
    order = in_order("last_event").desc()
    return asked.join(now, "repo_id").orderBy(order).select(F.lit(repo_name).alias("asked"), "repo_id", "repo_name")
