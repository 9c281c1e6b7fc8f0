"""Language lookup and exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import month_number
from tidemark.schema import CANONICAL_COLUMNS
from tidemark.sources.store import EVENTS_DDL, LOAD, exists, read_table


def enrich_language(
    events: DataFrame, repo_languages: DataFrame, unique: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Fill `language` from (repo_id, language); repositories without an entry keep ''.

    No broadcast hint: the lookup grows with the number of repositories, so Catalyst and adaptive
    execution broadcast it only while it is measured to be small, and otherwise sort-merge with skew
    splitting, which cuts a hot repository into several tasks. Set `unique` if `repo_id` is known to be
    a key of the lookup; otherwise it is made one first, because a second row would multiply events.
    `keep` names columns that stay beside the canonical ones.
    """
    lookup = repo_languages.select("repo_id", F.col("language").alias("_language"))
    if not unique:
        lookup = lookup.groupBy("repo_id").agg(F.max("_language").alias("_language"))
    return events.join(lookup, "repo_id", "left").select(
        *[
            F.coalesce("_language", F.lit("")).alias("language") if c == "language" else F.col(c)
            for c in CANONICAL_COLUMNS
        ],
        *keep,
    )


def dedup_events(events: DataFrame) -> DataFrame:
    """One row per event id. Where copies differ, the smallest row in column order is kept, so reruns agree.

    Identical copies (the normal case: a batch delivered twice) collapse in the map-side step of the
    grouping, before the shuffle; ids are unique, so no task gets a hot group.
    """
    return (
        events.select(*CANONICAL_COLUMNS)
        .groupBy("event_id")
        .agg(F.min(F.struct(*CANONICAL_COLUMNS[1:])).alias("_row"))
        .select("event_id", "_row.*")
    )


def unseen_events(events: DataFrame, path: str, load: str | tuple[str, str]) -> DataFrame:
    """Events whose ids no other load of the stored table at `path` has; `load` (or from..to) is the one they will be written as.

    Copies within `events` stay, see `dedup_events`. An event has one `created_at` wherever it comes from, so only the months of
    the new events are read, and there the ids alone. The ids that both sides have are found first, by a semi-join from
    the stored side: Spark prunes that scan by a Bloom filter of the new ids once it is large. What is left to take out is small
    then. The events' own load plays no part, so a load that runs again gives the same rows.
    """
    spark = events.sparkSession
    if not exists(spark, path):
        return events
    first, last = (load, load) if isinstance(load, str) else load
    months = [r.m for r in events.select(month_number("created_at").alias("m")).distinct().collect()]
    others = read_table(spark, path, EVENTS_DDL, months).filter(~F.col(LOAD).between(first, last))
    ids = events.select("event_id").distinct()
    known = others.select("event_id").join(ids, "event_id", "left_semi").distinct()
    return events.join(known, "event_id", "left_anti").select(*events.columns)
