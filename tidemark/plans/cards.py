"""Everything about one repository, found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.unsigned import as_bits, in_order
from tidemark.schema import FORK, ISSUES, PUSH


def repo_lookup(events: DataFrame, repo_name: str) -> DataFrame:
    """Always one row: newest id under this name, all events, pushes, forks, issues; 0 events = unknown."""
    of_type = {"pushes": PUSH, "forks": FORK, "issues": ISSUES}
    return events.filter(F.col("repo_name") == repo_name).agg(
        F.max_by("repo_id", in_order("event_id")).alias("repo_id"),
        F.count("*").alias("total_events"),
        *[F.count_if(F.col("event_type") == t).alias(name) for name, t in of_type.items()],
    )


def _stars_of(rollup: DataFrame, repo_id) -> DataFrame:
    return rollup.filter(F.col("repo_id") == (as_bits(repo_id) if isinstance(repo_id, int) else repo_id))


def repo_stars_total(rollup: DataFrame, repo_id) -> DataFrame:
    """Stars over all history, 0 if there are none."""
    return _stars_of(rollup, repo_id).agg(F.coalesce(F.sum("stars"), F.lit(0)).alias("stars"))


def repo_stars_by_day(rollup: DataFrame, repo_id) -> DataFrame:
    """Stars per day, only days that have some, oldest first."""
    return (
        _stars_of(rollup, repo_id)
        .groupBy(F.to_date("hour").alias("date"))
        .agg(F.sum("stars").alias("stars"))
        .orderBy("date")
    )


def repo_card(events: DataFrame, rollup: DataFrame, repo_name: str) -> DataFrame:
    """One row for a known name, none for an unknown one.

    Pushes, forks and issues go by name, stars by the id the name resolves to. The id is a scalar subquery,
    so it is known before the roll-up is read and reaches its scan as a plain comparison.
    """
    return card_of(repo_lookup(events, repo_name), rollup, repo_name)


def card_of(found: DataFrame, rollup: DataFrame, repo_name: str) -> DataFrame:
    """The card for a look-up by name, from events (`repo_lookup`) or from stored names (`names.lookup_from_names`)."""
    per_day = (
        _stars_of(rollup, found.select("repo_id").scalar())
        .groupBy(F.to_date("hour").alias("date"))
        .agg(F.sum("stars").alias("stars"))
    )
    # One list entry per day: bounded by the length of the history.
    history = per_day.agg(
        F.coalesce(F.sum("stars"), F.lit(0)).alias("stars"),
        F.array_sort(F.collect_list(F.struct("date", "stars"))).alias("stars_by_day"),
    )
    return (
        found.withColumns({c: history.select(c).scalar() for c in ("stars", "stars_by_day")})
        .filter(F.col("total_events") > 0)
        .select(
            "repo_id",
            F.lit(repo_name).alias("repo_name"),
            "stars",
            "pushes",
            "forks",
            "issues",
            "stars_by_day",
        )
    )
