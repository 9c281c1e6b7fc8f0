"""Every operator as a named query on the sample tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import reduce
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import month_number, ts_lit
from tidemark.operators.admission import sliding_window_admission
from tidemark.operators.enrich import dedup_events, unseen_events
from tidemark.operators.equivalence import result_differences, result_fingerprint
from tidemark.operators.filters import between, of_month
from tidemark.operators.names import fold_names, lookup_from_names, name_history, read_names, write_names
from tidemark.operators.normalize import normalize_events, payload_epoch, reject_counts, tag_events
from tidemark.operators.profiles import (
    column_profile,
    event_type_mix,
    key_frequency,
    key_skew,
    payload_size_profile,
    ref_form_profile,
)
from tidemark.operators.reconcile import fold_fingerprints, reconcile_months, write_fingerprints
from tidemark.operators.rollups import (
    activity_weekday_hour,
    backfill_rollups,
    fold_rollup,
    language_daily,
    merge_stored,
    read_rollup,
    reconcile_rollups,
    repo_stars_hourly,
    write_rollups,
)
from tidemark.operators.sketches import (
    CORPUS_DAILY,
    FREQUENT_KEYS,
    KEYS_DAILY,
    KLL_RANK_ERROR,
    PAYLOAD_DAILY,
    corpus_from_sketches,
    fold_sketches,
    heavy_keys,
    key_bounds,
    read_sketches,
    sizes_from_sketches,
    write_sketches,
)
from tidemark.operators.validate import check_messages, poison_messages, valid_events
from tidemark.plans import activity, cards, completeness, corpus, languages
from tidemark.plans import trending as top
from tidemark.samples import sql
from tidemark.samples.landing import ARCHIVE_DAY, land_archive, land_archive_day, land_pages
from tidemark.samples.tables import (
    AS_OF,
    bus_messages,
    enriched_events,
    raw_events,
    repo_languages,
    sample_events,
    with_big_ids,
)
from tidemark.schema import ACTIVITY, CANONICAL_COLUMNS, LANGUAGE_DAILY, MESSAGE, REPO_STARS_HOURLY, STAR
from tidemark.session import work_dir
from tidemark.sources.bus import read_event_stream, to_bus_messages
from tidemark.sources.archive import index_archive, read_archive
from tidemark.sources.pages import read_event_pages
from tidemark.sources.store import (
    DEAD_LETTERS,
    EVENT_ORDER,
    batch_load,
    drop_month,
    fold_events,
    read_dead_letters,
    read_events,
    replace_month,
    write_dead_letters,
    write_events,
)
from tidemark.streaming.audit import batch_audit, batch_sizes, ingest_health, lag_by_partition, read_audit
from tidemark.streaming.admission import ROCKSDB, admission_stream
from tidemark.streaming.enrichment import enrich_changed, enrich_months, languages_of
from tidemark.streaming.progress import ProgressLog, read_progress
from tidemark.streaming.ingest import (
    Sinks,
    dedup_stream,
    fold_finished,
    ingest_archive,
    start_ingest,
    stream_identity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WEEK_AGO = "2024-01-24 00:00:00"
DAY_AGO = "2024-01-30 00:00:00"
MONTH_AGO = "2024-01-01 00:00:00"
LANGUAGE = "Brand#17"
REPO = "org2/repo42"
REPO_ID = 42
RANGE = ("2023-12-30 00:30:00", "2024-02-02 02:15:00")


def query(reference: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if reference is not None:
            SQL[function.__name__] = reference
        return function

    return register


def _stars(spark: SparkSession, sf: str, **narrow) -> DataFrame:
    return repo_stars_hourly(sample_events(spark, sf, types=[STAR], **narrow))


# Trending -----------------------------------------------------------------------------------------


@query(sql.trending(WEEK_AGO))
def trending(spark, sf):
    return top.trending(_stars(spark, sf, start=WEEK_AGO), AS_OF, "7d")


@query(sql.trending(DAY_AGO))
def trending_24h(spark, sf):
    return top.trending(_stars(spark, sf, start=DAY_AGO), AS_OF)


@query(sql.trending("2024-01-23 23:17:05"))
def trending_scan(spark, sf):
    events = sample_events(spark, sf, types=[STAR], start="2024-01-23 23:17:05")
    return top.trending_scan(events, "2024-01-30 23:17:05", "7d")


@query(sql.trending("2024-01-23 23:00:00"))
def trending_hour_aligned(spark, sf):
    events = sample_events(spark, sf, types=[STAR], start="2024-01-23 23:00:00")
    return top.trending_hour_aligned(events, "2024-01-30 23:17:05", "7d")


@query(sql.trending(WEEK_AGO, f"language = '{LANGUAGE}'", 20))
def trending_by_language(spark, sf):
    events = enriched_events(spark, sf, types=[STAR], start=WEEK_AGO)
    return top.trending_by_language(events, AS_OF, LANGUAGE, "7d", 20)


def _page_sql(inner: str, start: int, limit: int) -> str:
    return f"""SELECT repo_id, repo_name, stars,
  row_number() OVER (ORDER BY stars DESC, repo_id) + {start} AS rank, count(*) OVER () = {limit} AS has_next
FROM ({inner})"""


@query(_page_sql(sql.trending(WEEK_AGO, limit=10), 0, 10))
def trending_page_first(spark, sf):
    return top.trending_page(AS_OF, rollup=_stars(spark, sf, start=WEEK_AGO), window="7d", limit=10)


@query(_page_sql(sql.trending(WEEK_AGO, limit=25, having="count(*) < 5 OR (count(*) = 5 AND repo_id > 50)"), 10, 25))
def trending_page_next(spark, sf):
    rollup = _stars(spark, sf, start=WEEK_AGO)
    return top.trending_page(AS_OF, rollup=rollup, window="7d", limit=25, after=(5, 50, 10))


@query(_page_sql(sql.trending(WEEK_AGO, f"language = '{LANGUAGE}'", 3), 0, 3))
def trending_page_language(spark, sf):
    events = enriched_events(spark, sf, types=[STAR], start=WEEK_AGO)
    return top.trending_page(AS_OF, events=events, language=LANGUAGE, window="7d", limit=3)


@query(f"""{sql.ROLLUPS},
a AS (SELECT repo_id, sum(stars) AS stars FROM stars WHERE hour >= TIMESTAMP '{WEEK_AGO}' GROUP BY repo_id),
b AS (SELECT repo_id, count(*) AS stars FROM canon WHERE event_type = 'WatchEvent' AND created_at >= TIMESTAMP '{WEEK_AGO}'
      GROUP BY repo_id)
SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS differences""")
def trending_equivalence(spark, sf):
    by_rollup = top.star_totals(_stars(spark, sf), AS_OF, "7d")
    by_scan = top.star_totals_scan(sample_events(spark, sf), AS_OF, "7d")
    return result_differences(by_rollup, by_scan).agg(F.count("*").alias("differences"))


@query(f"""{sql.BASE} SELECT count(*) AS "rows", true AS same_hash FROM
(SELECT DISTINCT repo_id FROM canon WHERE event_type = 'WatchEvent' AND created_at >= TIMESTAMP '{WEEK_AGO}')""")
def trending_fingerprint(spark, sf):
    a = result_fingerprint(top.star_totals(_stars(spark, sf), AS_OF, "7d"))
    b = result_fingerprint(top.star_totals_scan(sample_events(spark, sf), AS_OF, "7d"))
    return a.join(b.withColumnRenamed("hash_sum", "other"), "rows", "left").select(
        "rows", F.coalesce(F.col("hash_sum") == F.col("other"), F.lit(False)).alias("same_hash")
    )


# Repository card ----------------------------------------------------------------------------------

_LOOKUP = f"""max_by(repo_id, event_id) AS repo_id, count(*) AS total_events,
  count(*) FILTER (event_type = 'PushEvent') AS pushes, count(*) FILTER (event_type = 'ForkEvent') AS forks,
  count(*) FILTER (event_type = 'IssuesEvent') AS issues FROM canon WHERE repo_name = '{REPO}'"""


@query(f"{sql.BASE} SELECT {_LOOKUP}")
def repo_lookup(spark, sf):
    return cards.repo_lookup(sample_events(spark, sf), REPO)


@query(f"{sql.ROLLUPS} SELECT CAST(coalesce(sum(stars), 0) AS BIGINT) AS stars FROM stars WHERE repo_id = {REPO_ID}")
def repo_stars_total(spark, sf):
    return cards.repo_stars_total(_stars(spark, sf), REPO_ID)


@query(f"""{sql.ROLLUPS} SELECT CAST(hour AS DATE) AS date, CAST(sum(stars) AS BIGINT) AS stars
FROM stars WHERE repo_id = {REPO_ID} GROUP BY CAST(hour AS DATE) ORDER BY date""")
def repo_stars_by_day(spark, sf):
    return cards.repo_stars_by_day(_stars(spark, sf), REPO_ID)


@query(f"""{sql.ROLLUPS}, found AS (SELECT {_LOOKUP}),
days AS (SELECT repo_id, CAST(hour AS DATE) AS date, sum(stars) AS stars FROM stars GROUP BY ALL)
SELECT f.repo_id, '{REPO}' AS repo_name, CAST(coalesce(sum(d.stars) OVER (), 0) AS BIGINT) AS stars, pushes, forks, issues,
  CAST(row_number() OVER (ORDER BY d.date) - 1 AS INTEGER) AS pos, d.date, CAST(d.stars AS BIGINT) AS day_stars
FROM found f LEFT JOIN days d ON d.repo_id = f.repo_id WHERE total_events > 0""")
def repo_card(spark, sf):
    """The card with its whole list, one row per day."""
    card = cards.repo_card(sample_events(spark, sf), _stars(spark, sf), REPO)
    card = card.select("*", F.posexplode("stars_by_day").alias("pos", "day"))
    return card.select(
        "repo_id", "repo_name", "stars", "pushes", "forks", "issues", "pos", "day.date", F.col("day.stars").alias("day_stars")
    )


@query(f"{sql.BASE} SELECT repo_id, repo_name FROM canon WHERE repo_name = 'no/such'")
def repo_card_unknown(spark, sf):
    return cards.repo_card(sample_events(spark, sf), _stars(spark, sf), "no/such").select("repo_id", "repo_name")


# A repository gets a new name in the middle of the sample, and another one takes its old name.
_RENAMED = f"""{sql.BASE}, renamed AS (SELECT * REPLACE (CASE
    WHEN repo_id = {REPO_ID} AND created_at >= TIMESTAMP '2024-01-16' THEN 'new/name'
    WHEN repo_id = 52 AND created_at >= TIMESTAMP '2024-01-21' THEN '{REPO}' ELSE repo_name END AS repo_name) FROM canon),
found AS (SELECT asked, max_by(repo_id, event_id) AS repo_id, count(*) FILTER (event_type = 'PushEvent') AS pushes,
    count(*) FILTER (event_type = 'ForkEvent') AS forks, count(*) FILTER (event_type = 'IssuesEvent') AS issues
  FROM renamed JOIN (SELECT unnest(['{REPO}', 'new/name']) AS asked) ON repo_name = asked GROUP BY asked)"""


def _renamed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored names, of three loads, one of them run again and two folded, and the star roll-up."""
    path, events = work_dir(spark, "names"), sample_events(spark, sf)
    name = (
        F.when((F.col("repo_id") == REPO_ID) & (F.col("created_at") >= ts_lit("2024-01-16")), "new/name")
        .when((F.col("repo_id") == 52) & (F.col("created_at") >= ts_lit("2024-01-21")), REPO)
        .otherwise(F.col("repo_name"))
    )
    events = events.withColumn("repo_name", name)
    for number in (0, 1, 1, 2):
        write_names(events.filter(F.col("event_id") % 3 == number), path, batch_load("live", number))
    fold_names(spark, path, "live", 2)
    return read_names(spark, path), repo_stars_hourly(events)


@query(f"""{_RENAMED} SELECT asked AS repo_name, repo_id, pushes, forks, issues,
  (SELECT count(*) FROM canon WHERE event_type = 'WatchEvent' AND canon.repo_id = found.repo_id) AS stars FROM found""")
def repo_card_renamed(spark, sf):
    """Cards of a new name and of an old name that another repository has now, from stored names alone."""
    names, stars = _renamed(spark, sf)
    found = [cards.card_of(lookup_from_names(names, n), stars, n) for n in (REPO, "new/name")]
    return found[0].unionByName(found[1]).select("repo_name", "repo_id", "pushes", "forks", "issues", "stars")


@query(f"""{_RENAMED}, spans AS (SELECT repo_id, repo_name, min(created_at) AS since, max(created_at) AS until, count(*) AS events
  FROM renamed GROUP BY ALL),
ends AS (SELECT *, least(lead(since) OVER (PARTITION BY repo_id ORDER BY since, repo_name),
  lead(since) OVER (PARTITION BY repo_name ORDER BY since, repo_id)) AS e FROM spans)
SELECT repo_id, repo_name, since AS valid_from, CASE WHEN until > e THEN until ELSE e END AS valid_to, events FROM ends""")
def name_periods(spark, sf):
    return name_history(_renamed(spark, sf)[0])


# Languages, activity, corpus, completeness ---------------------------------------------------------


@query(f"""{sql.BASE} SELECT count(*) FILTER (language <> '') AS known, count(*) AS total,
  coalesce(count(*) FILTER (language <> '') / nullif(count(*), 0), 0.0) AS coverage
FROM canon WHERE created_at >= TIMESTAMP '{WEEK_AGO}'""")
def language_coverage(spark, sf):
    return languages.language_coverage(enriched_events(spark, sf, start=WEEK_AGO), AS_OF, "7d")


@query(f"""{sql.ROLLUPS} SELECT language, day AS date, events FROM langs WHERE day >= DATE '2024-01-01'
ORDER BY language, date""")
def language_trends(spark, sf):
    return languages.language_trends(language_daily(enriched_events(spark, sf)), AS_OF, "30d")


@query(f"""{sql.ROLLUPS} SELECT language, CAST(row_number() OVER (PARTITION BY language ORDER BY day) - 1 AS INTEGER) AS pos,
  day AS date, events FROM langs WHERE day >= DATE '2024-01-24'""")
def language_series(spark, sf):
    series = languages.language_series(language_daily(enriched_events(spark, sf, start=WEEK_AGO)), AS_OF, "7d")
    return series.select("language", F.posexplode("points").alias("pos", "point")).select("language", "pos", "point.*")


@query(f"""{sql.ROLLUPS} SELECT ['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'][weekday] AS weekday,
  hour, events FROM activity ORDER BY activity.weekday, hour""")
def activity_heatmap(spark, sf):
    return activity.activity_heatmap(activity_weekday_hour(sample_events(spark, sf)))


@query(f"""{sql.BASE} SELECT count(*) AS events_total, min(created_at) AS oldest, max(created_at) AS newest,
  date_diff('second', max(created_at), TIMESTAMP '{AS_OF}') AS ingest_lag_seconds,
  count(DISTINCT repo_id) AS distinct_repos, count(DISTINCT actor_id) AS distinct_actors FROM canon""")
def corpus_stats_exact(spark, sf):
    return corpus.corpus_stats(sample_events(spark, sf), AS_OF, exact=True)


@query(f"{sql.BASE} SELECT count(*) AS events_total, true AS repos_close, true AS actors_close FROM canon")
def corpus_stats_approx(spark, sf):
    events = sample_events(spark, sf)
    exact = corpus.corpus_stats(events, AS_OF, exact=True).select(
        "events_total", F.col("distinct_repos").alias("r"), F.col("distinct_actors").alias("a")
    )
    both = corpus.corpus_stats(events, AS_OF).join(exact, "events_total")
    return both.select(
        "events_total",
        (F.abs(F.col("distinct_repos") - F.col("r")) <= 0.05 * F.col("r")).alias("repos_close"),
        (F.abs(F.col("distinct_actors") - F.col("a")) <= 0.05 * F.col("a")).alias("actors_close"),
    )


def _sketched(spark: SparkSession, sf: str, *names: str) -> str:
    """Daily sketches of three loads, of which one is run again and two are folded."""
    root, events = work_dir(spark, "sketches"), sample_events(spark, sf)
    for number in (0, 1, 2, 1):
        write_sketches(events.filter(F.col("event_id") % 3 == number), root, batch_load("live", number), list(names))
    for name in names:
        fold_sketches(spark, root, name, "live", 2)
    return root


@query(f"""{sql.BASE} SELECT count(*) AS events_total, min(created_at) AS oldest, max(created_at) AS newest,
  date_diff('second', max(created_at), TIMESTAMP '{AS_OF}') AS ingest_lag_seconds, true AS repos_close, true AS actors_close FROM canon""")
def corpus_stats_sketched(spark, sf):
    """The corpus figures from stored daily sketches, beside exact distinct counts."""
    days = read_sketches(spark, _sketched(spark, sf, CORPUS_DAILY), CORPUS_DAILY)
    exact = corpus.corpus_stats(sample_events(spark, sf), AS_OF, exact=True).select(
        "events_total", F.col("distinct_repos").alias("r"), F.col("distinct_actors").alias("a")
    )
    both = corpus_from_sketches(days, AS_OF).join(exact, "events_total")
    return both.select(
        "events_total",
        "oldest",
        "newest",
        "ingest_lag_seconds",
        (F.abs(F.col("distinct_repos") - F.col("r")) <= 0.03 * F.col("r")).alias("repos_close"),
        (F.abs(F.col("distinct_actors") - F.col("a")) <= 0.03 * F.col("a")).alias("actors_close"),
    )


@query(f"""{sql.BASE} SELECT event_type, 'old' AS epoch, count(*) AS events, min(payload_size) AS min_size, max(payload_size) AS max_size,
  true AS p50_close, true AS p90_close FROM canon GROUP BY 1""")
def payload_sizes_sketched(spark, sf):
    """Sizes at ranks 0.5 and 0.9 from stored daily sketches; close means that the exact ranks around them hold the wanted one."""
    days = read_sketches(spark, _sketched(spark, sf, PAYLOAD_DAILY), PAYLOAD_DAILY)
    found = sizes_from_sketches(days, (0.5, 0.9)).alias("f")
    sizes = sample_events(spark, sf).groupBy("event_type", "payload_size").agg(F.count("*").alias("n")).alias("s")
    total = F.first("events")

    def close(rank: float, value: str):
        below, upto = (F.sum(F.when(c, F.col("n")).otherwise(0)) / total for c in (F.col("payload_size") < F.col(value), F.col("payload_size") <= F.col(value)))
        return ((below <= rank + KLL_RANK_ERROR) & (upto >= rank - KLL_RANK_ERROR)).alias(f"{value}_close")

    return found.join(sizes, "event_type").groupBy("event_type", "epoch", "events", "min_size", "max_size").agg(close(0.5, "p50"), close(0.9, "p90"))


@query(f"""{sql.BASE}, n AS (SELECT 'repo_id' AS "key", count(*) AS n FROM canon GROUP BY repo_id
  UNION ALL SELECT 'actor_id', count(*) FROM canon GROUP BY actor_id)
SELECT "key", CAST(sum(n) AS BIGINT) AS events, max(n) AS largest, true AS inside FROM n GROUP BY 1""")
def key_bounds_sketched(spark, sf):
    """Bounds of the largest key from stored summaries, beside its exact count."""
    days = read_sketches(spark, _sketched(spark, sf, KEYS_DAILY), KEYS_DAILY)
    exact = key_frequency(sample_events(spark, sf), FREQUENT_KEYS).select("key", "largest")
    bounds = reduce(DataFrame.unionByName, [key_bounds(days, k) for k in FREQUENT_KEYS]).join(exact, "key")
    return bounds.select("key", "events", "largest", F.col("largest").between(F.col("largest_least"), F.col("largest_most")).alias("inside"))


@query(f"""{sql.BASE} SELECT repo_id, count(*) AS n, count(*) / (SELECT count(*) FROM canon) AS share FROM canon GROUP BY 1
HAVING count(*) >= 0.0105 * (SELECT count(*) FROM canon) ORDER BY n DESC, repo_id""")
def heavy_repos(spark, sf):
    """Repositories with at least 1.05 % of all events: named by the summaries, counted exactly."""
    days = read_sketches(spark, _sketched(spark, sf, KEYS_DAILY), KEYS_DAILY)
    return heavy_keys(sample_events(spark, sf), days, "repo_id", 0.0105)


_IN_RANGE = f"created_at >= TIMESTAMP '{RANGE[0]}' AND created_at < TIMESTAMP '{RANGE[1]}'"
_MISSING = f"""{sql.BASE}, present AS (SELECT DISTINCT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour
  FROM canon WHERE {_IN_RANGE}),
missing AS (SELECT CAST(g AS TIMESTAMP) AS hour FROM
  generate_series(TIMESTAMP '2023-12-30 00:00:00', TIMESTAMP '2024-02-02 01:00:00', INTERVAL 1 HOUR) t(g)
  WHERE g NOT IN (SELECT hour FROM present))"""


@query(f"{_MISSING} SELECT hour FROM present ORDER BY hour")
def present_hours(spark, sf):
    return completeness.present_hours(sample_events(spark, sf), *RANGE)


@query(f"{_MISSING} SELECT hour FROM missing ORDER BY hour")
def missing_hours(spark, sf):
    return completeness.missing_hours(sample_events(spark, sf), *RANGE)


@query(f"""{_MISSING} SELECT CAST(817 AS BIGINT) AS total_hours, count(*) OVER () AS missing_count,
  CAST(row_number() OVER (ORDER BY hour) - 1 AS INTEGER) AS pos, hour FROM missing""")
def completeness_summary(spark, sf):
    """The summary with its whole list, one row per missing hour."""
    summary = completeness.completeness_summary(sample_events(spark, sf), *RANGE)
    return summary.select("total_hours", "missing_count", F.posexplode("missing_hours").alias("pos", "hour"))


# Filters --------------------------------------------------------------------------------------------


@query(f"""{sql.BASE} SELECT {sql.UNENRICHED} FROM canon
WHERE created_at >= TIMESTAMP '2024-01-10 12:30:00' AND created_at < TIMESTAMP '2024-01-20'""")
def events_in_range(spark, sf):
    return sample_events(spark, sf).filter(between("2024-01-10 14:30:00+02:00", "2024-01-20"))


@query(f"{sql.BASE} SELECT event_type, count(*) AS n FROM canon WHERE year(created_at) * 100 + month(created_at) = 202401 GROUP BY 1")
def events_of_month(spark, sf):
    return of_month(sample_events(spark, sf), 202401).groupBy("event_type").agg(F.count("*").alias("n"))


# Roll-ups -------------------------------------------------------------------------------------------


_STARS_SQL = f"{sql.ROLLUPS} SELECT repo_id, repo_name, hour, stars, last_event_id FROM stars"
_LANGS_SQL = f"{sql.ROLLUPS} SELECT day, language, events FROM langs"
_ACTIVITY_SQL = f"{sql.ROLLUPS} SELECT weekday, hour, events FROM activity"


@query(_STARS_SQL)
def rollup_repo_stars_hourly(spark, sf):
    return _stars(spark, sf)


@query(_LANGS_SQL)
def rollup_language_daily(spark, sf):
    return language_daily(enriched_events(spark, sf))


@query(_ACTIVITY_SQL)
def rollup_activity(spark, sf):
    return activity_weekday_hour(sample_events(spark, sf))


@query(_STARS_SQL)
def merge_rollup_partials(spark, sf):
    """Partial rows as separate loads would leave them: one set per event-id parity, then merged."""
    events = sample_events(spark, sf, types=[STAR])
    odd = F.col("event_id") % 2 == 1
    partials = repo_stars_hourly(events.filter(odd)).unionByName(repo_stars_hourly(events.filter(~odd)))
    return merge_stored(REPO_STARS_HOURLY, partials)


@query(f"""{sql.ROLLUPS} SELECT 'repo_stars_hourly' AS rollup, (SELECT count(*) FROM canon WHERE event_type = 'WatchEvent') AS in_events,
  (SELECT CAST(sum(stars) AS BIGINT) FROM stars) AS in_rollup, CAST(0 AS BIGINT) AS difference
UNION ALL SELECT 'language_daily', (SELECT count(*) FROM canon WHERE language <> ''), (SELECT CAST(sum(events) AS BIGINT) FROM langs), 0
UNION ALL SELECT 'activity_weekday_hour', (SELECT count(*) FROM canon), (SELECT CAST(sum(events) AS BIGINT) FROM activity), 0""")
def reconcile(spark, sf):
    events = enriched_events(spark, sf)
    rollups = {
        REPO_STARS_HOURLY: repo_stars_hourly(events),
        LANGUAGE_DAILY: language_daily(events),
        ACTIVITY: activity_weekday_hour(events),
    }
    return reconcile_rollups(events, rollups)


@query(f"""{sql.ROLLUPS}
SELECT 'repo_stars_hourly' AS rollup, CAST(year(hour) * 100 + month(hour) AS INTEGER) AS ym,
  repo_id || '|' || strftime(hour, '%Y-%m-%d %H:%M:%S') AS "key", stars AS in_events, 2 * stars AS in_rollup FROM stars WHERE repo_id = {REPO_ID}
UNION ALL SELECT 'language_daily', CAST(year(day) * 100 + month(day) AS INTEGER), language || '|' || CAST(day AS VARCHAR), events, 0
FROM langs WHERE day = DATE '2024-01-15'""")
def reconcile_by_month(spark, sf):
    """Two loads, of which one is run again; one roll-up counts a repository twice, another one lacks a day."""
    sinks, events = Sinks(work_dir(spark, "reconcile")), enriched_events(spark, sf)
    for number in (0, 1, 1):
        rows, load = events.filter(F.col("event_id") % 2 == number), batch_load("live", number)
        write_events(rows, sinks.events, load)
        write_fingerprints(rows, sinks.fingerprints, load)
        write_rollups(rows, sinks.rollups, load, [REPO_STARS_HOURLY, ACTIVITY])
        write_rollups(rows.filter("to_date(created_at) <> DATE'2024-01-15'"), sinks.rollups, load, [LANGUAGE_DAILY])
    fold_fingerprints(spark, sinks.fingerprints, "live", 2)
    write_rollups(events.filter(F.col("repo_id") == REPO_ID), sinks.rollups, "planted", [REPO_STARS_HOURLY])
    return reconcile_months(spark, sinks.events, sinks.fingerprints, sinks.rollups)


@query(_STARS_SQL)
def backfill_repo_stars(spark, sf):
    """Two live loads, then two backfills of the month: the sums must be those of one pass."""
    root = work_dir(spark, "backfill")
    events = sample_events(spark, sf)
    write_rollups(events.filter("event_id % 2 = 0"), root, "live-1")
    write_rollups(events.filter("event_id % 2 = 1"), root, "live-2")
    for _ in range(2):
        backfill_rollups(events, root, _months(spark, sf))
    return read_rollup(spark, root, REPO_STARS_HOURLY)


@query(_LANGS_SQL)
def compact_language_daily(spark, sf):
    root = work_dir(spark, "compact")
    events = enriched_events(spark, sf)
    write_rollups(events.filter("event_id % 3 = 0"), root, batch_load("live", 0))
    write_rollups(events.filter("event_id % 3 > 0"), root, batch_load("live", 1))
    fold_rollup(spark, root, LANGUAGE_DAILY, "live", 2)
    return read_rollup(spark, root, LANGUAGE_DAILY)


# Normalising raw events -----------------------------------------------------------------------------


@query(f"{sql.RAW} SELECT {sql.CANON_COLUMNS} FROM tagged WHERE reject_reason IS NULL")
def normalize(spark, sf):
    return normalize_events(raw_events(sample_events(spark, sf)))[0]


@query(f"{sql.RAW} SELECT reject_reason, count(*) AS rejected FROM tagged WHERE reject_reason IS NOT NULL GROUP BY 1")
def normalize_reject_counts(spark, sf):
    return reject_counts(tag_events(raw_events(sample_events(spark, sf))))


@query(f"""{sql.RAW} SELECT event_type, ref, payload_size, count(*) AS n FROM tagged WHERE reject_reason IS NULL GROUP BY ALL""")
def payload_fields(spark, sf):
    events, _ = normalize_events(raw_events(sample_events(spark, sf)))
    return events.groupBy("event_type", "ref", "payload_size").agg(F.count("*").alias("n"))


@query(f"""{sql.RAW} SELECT CASE WHEN event_type <> 'PushEvent' OR repo_id = 92 THEN ''
  WHEN repo_id % 2 = 0 AND repo_id <> 98 THEN 'old' ELSE 'new' END AS epoch, count(*) AS n
FROM tagged WHERE repo_id <> 94 GROUP BY 1""")
def payload_epochs(spark, sf):
    raw = raw_events(sample_events(spark, sf))
    whole = raw.filter(F.col("_corrupt_record").isNull())
    return whole.groupBy(payload_epoch(whole).alias("epoch")).agg(F.count("*").alias("n"))


_ACCEPTED_SQL = f"{sql.RAW} SELECT {sql.CANON_COLUMNS} FROM tagged WHERE reject_reason IS NULL"


def _months(spark: SparkSession, sf: str) -> list[int]:
    """The months of the sample, one value per month of history."""
    months = sample_events(spark, sf).select(month_number("created_at").alias("m")).distinct()
    return sorted(r.m for r in months.collect())


def _archive_hours(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The hours [start, end) of the sample's events, as the archive names them."""
    first, last = sample_events(spark, sf).agg(F.min("created_at"), F.max("created_at")).first()
    end = last + timedelta(hours=1)
    return f"{first:%Y-%m-%d}-{first.hour}", f"{end:%Y-%m-%d}-{end.hour}"


_ARCHIVED_SQL = f"{sql.ARCHIVE} SELECT {sql.CANON_COLUMNS} FROM lines WHERE reject_reason IS NULL"


@query(_ARCHIVED_SQL)
def archive_read(spark, sf):
    hours = _archive_hours(spark, sf)
    base = land_archive(spark, sample_events(spark, sf), *hours)
    return normalize_events(read_archive(spark, base, *hours))[0]


@query(f"{sql.ARCHIVE} SELECT reject_reason, count(*) AS rejected FROM lines WHERE reject_reason IS NOT NULL GROUP BY 1")
def archive_reject_counts(spark, sf):
    """The whole time span as one file of several gzip members, read by several tasks from its restart points."""
    base, index = land_archive_day(spark, sample_events(spark, sf)), f"{work_dir(spark, 'restarts')}/index.json"
    index_archive(spark, base, ARCHIVE_DAY, None, index, parts=2 * spark.sparkContext.defaultParallelism, every=1 << 16)
    return reject_counts(normalize_events(read_archive(spark, base, ARCHIVE_DAY, index=index))[1])


@query(f"""{sql.ARCHIVE} SELECT repo_id, max_by(repo_name, event_id) AS repo_name, CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour,
  count(*) AS stars, max(event_id) AS last_event_id FROM lines WHERE reject_reason IS NULL AND event_type = 'WatchEvent'
GROUP BY repo_id, date_trunc('hour', created_at)""")
def archive_load_rollups(spark, sf):
    """Dumps to stored events and roll-ups, loaded twice."""
    hours = _archive_hours(spark, sf)
    base = land_archive(spark, sample_events(spark, sf), *hours)
    sinks = Sinks(work_dir(spark, "archive-load"))
    for _ in range(2):
        ingest_archive(spark, base, *hours, sinks)
    return merge_stored(REPO_STARS_HOURLY, read_rollup(spark, sinks.rollups, REPO_STARS_HOURLY))


@query(_ACCEPTED_SQL)
def page_read(spark, sf):
    return normalize_events(read_event_pages(spark, land_pages(spark, sample_events(spark, sf))))[0]


@query(f"{sql.RAW} SELECT reject_reason, count(*) AS rejected FROM tagged WHERE reject_reason IS NOT NULL GROUP BY 1")
def page_reject_counts(spark, sf):
    return reject_counts(normalize_events(read_event_pages(spark, land_pages(spark, sample_events(spark, sf))))[1])


@query(f"{sql.BASE} SELECT {sql.CANON_COLUMNS} FROM canon")
def enrich(spark, sf):
    return enriched_events(spark, sf)


@query(f"{sql.BASE} SELECT {sql.WIDE} FROM canon")
def dedup(spark, sf):
    events = with_big_ids(sample_events(spark, sf))
    return dedup_events(events.unionByName(events).unionByName(events.filter("repo_id > 50")))


@query(f"{sql.BASE} SELECT {sql.UNENRICHED} FROM canon WHERE event_id % 3 > 0 OR event_id % 2 = 0")
def dedup_stored(spark, sf):
    """Two sources that overlap, the second one delivered twice and run again: every id is stored once."""
    path, events = work_dir(spark, "overlap"), sample_events(spark, sf)
    write_events(events.filter("event_id % 3 > 0"), path, batch_load("one", 0))
    second = events.filter("event_id % 2 = 0")
    for number in (0, 0, 1):
        load = batch_load("two", number)
        write_events(unseen_events(second, path, load), path, load)
    return read_events(spark, path)


# Messages -------------------------------------------------------------------------------------------


@query(f"""{sql.BASE} SELECT CAST(event_id AS VARCHAR) AS "key",
  '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')
  || '","actor_id":' || actor_id || ',"actor_login":"' || actor_login || '","repo_id":' || repo_id || ',"repo_name":"' || repo_name
  || '","org_id":' || org_id || ',"language":"' || language || '","payload_size":' || payload_size || ',"ref":"' || ref || '"}}' AS "value"
FROM canon""")
def bus_encode(spark, sf):
    return to_bus_messages(enriched_events(spark, sf))


_VALID_SQL = f"{sql.BUS} SELECT {sql.CANON_COLUMNS} FROM checked WHERE error IS NULL"


@query(f'{sql.BUS} SELECT {sql.CANON_COLUMNS}, "partition", "offset" FROM checked WHERE error IS NULL')
def validate_events(spark, sf):
    return valid_events(check_messages(bus_messages(sample_events(spark, sf))), with_place=True)


_POISON_SQL = f"""{sql.BUS} SELECT CAST(event_id AS VARCHAR) AS "key", {sql.MESSAGE_VALUE} AS "value", error,
  'PoisonMessageError' AS error_type, "partition" AS source_partition, "offset" AS source_offset
FROM checked WHERE error IS NOT NULL"""


@query(_POISON_SQL)
def validate_poison(spark, sf):
    return poison_messages(check_messages(bus_messages(sample_events(spark, sf))))


# Stored tables --------------------------------------------------------------------------------------


@query(f"""{sql.BASE} SELECT {sql.UNENRICHED} FROM canon
WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-25 12:00:00'""")
def store_events(spark, sf):
    path = work_dir(spark, "events")
    events = sample_events(spark, sf)
    write_events(events, path, "a")
    write_events(events, path, "a")  # the same load again must change nothing
    return read_events(spark, path, "2024-01-05", "2024-01-25 12:00:00")


@query(f"{sql.BASE} SELECT {sql.UNENRICHED} FROM canon WHERE repo_id <= 50")
def store_drop_month(spark, sf):
    path = work_dir(spark, "drop")
    moved = F.when(F.col("repo_id") > 50, F.col("created_at") + F.expr("INTERVAL 100 YEARS")).otherwise(F.col("created_at"))
    write_events(sample_events(spark, sf).withColumn("created_at", moved), path, "a")
    for month in _months(spark, sf):
        drop_month(spark, path, month + 100 * 100)
    return read_events(spark, path)


@query(f"{sql.BASE} SELECT {sql.UNENRICHED} FROM canon WHERE repo_id <= 50")
def store_replace_month(spark, sf):
    path = work_dir(spark, "replace")
    events = sample_events(spark, sf)
    write_events(events, path, "a")
    write_events(events, path, "b")
    for month in _months(spark, sf):
        replace_month(of_month(events, month).filter("repo_id <= 50"), path, month, "reload", EVENT_ORDER, ["event_type"])
    return read_events(spark, path)


@query(f"{sql.BASE} SELECT {sql.UNENRICHED} FROM canon")
def store_compact_month(spark, sf):
    path = work_dir(spark, "compact-events")
    events = sample_events(spark, sf)
    for part in range(3):
        write_events(events.filter(F.col("event_id") % 3 == part), path, batch_load("batch", part))
    fold_events(spark, path, "batch", 3)
    return read_events(spark, path)


@query(_POISON_SQL)
def store_dead_letters(spark, sf):
    path = work_dir(spark, "dead-letters")
    found = work_dir(spark, "found-letters")  # the messages are checked once, both loads read what was found
    poison_messages(check_messages(bus_messages(sample_events(spark, sf)))).write.parquet(found)
    letters = spark.read.schema(DEAD_LETTERS).parquet(found)
    for _ in range(2):
        write_dead_letters(letters, path, "a")
    return read_dead_letters(spark, path)


@query(SQL["language_trends"])
def enrich_stored_months(spark, sf):
    """Stored events without languages are enriched (twice), and the trends come from the stored roll-up."""
    sinks = Sinks(work_dir(spark, "enrich-months"))
    events = sample_events(spark, sf)
    write_events(events, sinks.events, "a")
    write_rollups(events, sinks.rollups, "a")
    for _ in range(2):
        enrich_months(spark, sinks, repo_languages(spark, sf), _months(spark, sf))
    return languages.language_trends(read_rollup(spark, sinks.rollups, LANGUAGE_DAILY), AS_OF, "30d")


def _changing_languages(spark: SparkSession, sf: str) -> Sinks:
    """Three batches; languages change after the first two, a third batch comes late, and the second one is run again.

    Version 1 lacks every third language and has wrong ones for every fifth repository; version 2 is right.
    """
    sinks = Sinks(work_dir(spark, "enrich-changed"))
    events, right = sample_events(spark, sf), repo_languages(spark, sf)
    languages = languages_of(spark, work_dir(spark, "languages"))
    wrong = F.when(F.col("repo_id") % 5 == 0, F.concat(F.lit("old "), "language")).otherwise(F.col("language"))

    def batch(number: int) -> None:
        rows = events.filter(F.col("event_id") % 3 == number)
        write_events(rows, sinks.events, batch_load("live", number))
        write_rollups(rows, sinks.rollups, batch_load("live", number), [LANGUAGE_DAILY])

    batch(0)
    batch(1)
    languages.publish(right.filter("repo_id % 3 > 0").withColumn("language", wrong))
    enrich_changed(spark, sinks, languages)
    batch(2)
    languages.publish(right)
    enrich_changed(spark, sinks, languages)
    batch(1)
    for _ in range(2):
        enrich_changed(spark, sinks, languages)
    return sinks


@query(f"{sql.BASE} SELECT {sql.CANON_COLUMNS} FROM canon")
def enrich_changed_languages(spark, sf):
    return read_events(spark, _changing_languages(spark, sf).events)


@query(_LANGS_SQL)
def enrich_changed_rollup(spark, sf):
    rows = read_rollup(spark, _changing_languages(spark, sf).rollups, LANGUAGE_DAILY)
    return merge_stored(LANGUAGE_DAILY, rows)


# Streams --------------------------------------------------------------------------------------------


def _land_messages(spark: SparkSession, messages: DataFrame) -> tuple[str, int]:
    """Messages as files, one or more per core, and how many of them make about half of all."""
    folder, files = work_dir(spark, "messages"), max(2, spark.sparkContext.defaultParallelism)
    columns = [F.col(f.name).cast(f.dataType) for f in MESSAGE.fields]
    messages.select(*columns).repartition(files).write.parquet(folder)
    return folder, files // 2


def _ingested(spark: SparkSession, sf: str) -> Sinks:
    landed, half = _land_messages(spark, bus_messages(sample_events(spark, sf)))
    sinks = Sinks(work_dir(spark, "ingest"))
    stream = read_event_stream(spark, files=landed, max_files=half)
    start_ingest(stream, sinks, work_dir(spark, "checkpoint"), {"availableNow": True}).awaitTermination()
    return sinks


@query(_VALID_SQL)
def stream_ingest(spark, sf):
    return read_events(spark, _ingested(spark, sf).events)


@query(_VALID_SQL)
def stream_two_sources(spark, sf):
    """Two streams with checkpoints of their own fill one set of tables; the first one's batches are folded in between."""
    messages = bus_messages(sample_events(spark, sf))
    sinks = Sinks(work_dir(spark, "two-sources"))
    for odd in (0, 1):
        landed, half = _land_messages(spark, messages.filter(F.col("partition") % 2 == odd))
        stream = read_event_stream(spark, files=landed, max_files=half)
        query = start_ingest(stream, sinks, work_dir(spark, "checkpoint"), {"availableNow": True}, beside=bool(odd))
        query.awaitTermination()
        own = replace(sinks, stream=stream_identity(query))
        fold_finished(spark, own, query.lastProgress["batchId"])
    return read_events(spark, sinks.events)


@query(f"""{sql.BUS} SELECT repo_id, max_by(repo_name, event_id) AS repo_name, CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour,
  count(*) AS stars, max(event_id) AS last_event_id FROM checked WHERE error IS NULL AND event_type = 'WatchEvent'
GROUP BY repo_id, date_trunc('hour', created_at)""")
def stream_rollups(spark, sf):
    sinks = _ingested(spark, sf)
    return merge_stored(REPO_STARS_HOURLY, read_rollup(spark, sinks.rollups, REPO_STARS_HOURLY))


@query(f"""{sql.BUS} SELECT "partition", count(*) AS consumed, count(*) FILTER (error IS NULL) AS inserted,
  count(*) FILTER (error IS NOT NULL) AS dead_lettered, max("offset") + 1 AS position FROM checked GROUP BY 1""")
def stream_audit(spark, sf):
    audit = read_audit(spark, _ingested(spark, sf).audit)
    sums = [F.sum(c).alias(c) for c in ("consumed", "inserted", "dead_lettered")]
    return audit.groupBy("partition").agg(*sums, F.max("position").alias("position"))


@query(_VALID_SQL)
def stream_dedup(spark, sf):
    """The whole message set delivered twice; copies meet within one batch and across batches."""
    messages = bus_messages(sample_events(spark, sf))
    landed, half = _land_messages(spark, messages.unionByName(messages))
    out = work_dir(spark, "dedup")
    events = valid_events(check_messages(read_event_stream(spark, files=landed, max_files=half)))
    (
        dedup_stream(events, "1 hour")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", work_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(out).select(*CANONICAL_COLUMNS)


_PARTS = 4  # the messages arrive in so many parts; the last one is still on the bus when the stream stops


def _observed_ingest(spark: SparkSession, sf: str) -> Sinks:
    """An ingest of all parts but the last, one batch each, with the listener that keeps the engine's reports.

    The bus knows the ends of all partitions but the fifth one, the last part included.
    """
    messages = bus_messages(sample_events(spark, sf))
    folder, files = work_dir(spark, "messages"), max(2, spark.sparkContext.defaultParallelism)
    columns = [F.col(f.name).cast(f.dataType) for f in MESSAGE.fields]
    for part in range(_PARTS - 1):
        arriving = messages.filter(F.col("offset") % _PARTS == part).select(*columns)
        arriving.repartitionByRange(files, "partition", "offset").write.option("maxRecordsPerFile", 0).mode("append").parquet(f"{folder}/{part}")
    ends = {r.partition: r.end for r in messages.groupBy("partition").agg((F.max("offset") + 1).alias("end")).collect()}
    sinks, checkpoint = Sinks(work_dir(spark, "observed")), work_dir(spark, "checkpoint")
    log = ProgressLog(spark, sinks)
    spark.streams.addListener(log)
    try:
        for part in range(_PARTS - 1):
            stream = read_event_stream(spark, files=f"{folder}/[0-{part}]")
            known = {p: end for p, end in ends.items() if p != 5}
            start_ingest(stream, sinks, checkpoint, {"availableNow": True}, lambda known=known: known).awaitTermination()
            log.wait()
    finally:
        spark.streams.removeListener(log)
    return sinks


# The parts as the SQL sees them: one batch each, the last one not read.
_BATCHES = f"""{sql.BUS},
read AS (SELECT "offset" % 4 AS batch_id, * FROM checked WHERE "offset" % 4 < 3),
ends AS (SELECT "partition", max("offset") + 1 AS end_offset FROM checked WHERE "partition" <> 5 GROUP BY 1)"""


@query(f"""{_BATCHES}, newest AS (SELECT "partition", max_by(position, batch_id) AS position FROM
  (SELECT "partition", batch_id, max("offset") + 1 AS position FROM read GROUP BY 1, 2) GROUP BY 1),
lag AS (SELECT "partition", end_offset - position AS lag FROM ends JOIN newest USING ("partition"))
SELECT "partition", lag FROM lag UNION ALL SELECT NULL, CAST(sum(lag) AS BIGINT) FROM lag""")
def partition_lag(spark, sf):
    return lag_by_partition(read_audit(spark, _observed_ingest(spark, sf).audit))


@query(f"""{_BATCHES} SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * batch_id AS interval_start, CAST(1 AS BIGINT) AS batches,
  count(*) AS consumed, count(*) FILTER (error IS NULL) AS inserted, count(*) FILTER (error IS NOT NULL) AS dead_lettered,
  count(*) / 86400 AS consumed_per_second, count(*) FILTER (error IS NULL) / 86400 AS inserted_per_second,
  100 * count(*) FILTER (error IS NOT NULL) / count(*) AS dead_letter_percent, true AS timed
FROM read GROUP BY batch_id""")
def ingest_health_by_day(spark, sf):
    """The clock of the run gives way to one day per batch, so that the result repeats."""
    audit = read_audit(spark, _observed_ingest(spark, sf).audit)
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("batch_id").cast("int"))
    health = ingest_health(audit.withColumn("ts", day), "1 day")
    return health.withColumn("timed", F.col("slowest_seconds") > 0).drop("slowest_seconds")


@query(f"""{_BATCHES}, sizes AS (SELECT count(*) FILTER (error IS NULL) AS size FROM read GROUP BY batch_id)
SELECT up_to, (SELECT count(*) FROM sizes WHERE size <= coalesce(up_to, 1e18)) AS batches
FROM (VALUES (1), (10), (100), (1000), (5000), (10000), (20000), (50000), (NULL)) t(up_to)""")
def ingest_batch_sizes(spark, sf):
    return batch_sizes(read_audit(spark, _observed_ingest(spark, sf).audit))


@query(f"""{_BATCHES} SELECT batch_id, count(*) AS input_rows, count(*) AS consumed, true AS timed FROM read GROUP BY batch_id""")
def engine_progress(spark, sf):
    """The engine's reports beside the rows that the audit counted."""
    sinks = _observed_ingest(spark, sf)
    counted = read_audit(spark, sinks.audit).groupBy("batch_id").agg(F.sum("consumed").alias("consumed"))
    reports = read_progress(spark, sinks).select("batch_id", "input_rows", (F.col("trigger_ms") >= F.col("add_batch_ms")).alias("timed"))
    return reports.join(counted, "batch_id").select("batch_id", "input_rows", "consumed", "timed")


@query(f"""{sql.BUS} SELECT CAST(7 AS BIGINT) AS batch_id, "partition", count(*) AS consumed,
  count(*) FILTER (error IS NULL) AS inserted, count(*) FILTER (error IS NOT NULL) AS dead_lettered,
  max("offset") + 1 AS position, CASE WHEN "partition" < 2 THEN CAST(1000000 AS BIGINT) END AS end_offset
FROM checked GROUP BY "partition" """)
def ingest_audit(spark, sf):
    checked = check_messages(bus_messages(sample_events(spark, sf)))
    return batch_audit(checked, 7, 0.5, {0: 1_000_000, 1: 1_000_000}).drop("ts", "latency_seconds")


# Profiles -------------------------------------------------------------------------------------------


@query(f"{sql.BASE} SELECT event_type, count(*) AS events, count(*) / sum(count(*)) OVER () AS share FROM canon GROUP BY 1")
def type_mix(spark, sf):
    return event_type_mix(sample_events(spark, sf))


_KEYS = ["event_id", "repo_id", "actor_id", "event_type"]


def _skew_union(skew: bool) -> str:
    keys = [(k, k) for k in _KEYS] + ([("constant", "'constant'")] if skew else [])
    ctes = "".join(f", t_{k} AS (SELECT {v} AS v, count(*) AS n FROM canon GROUP BY 1)" for k, v in keys)
    parts = []
    for k, _ in keys:
        bucket = "CAST('0x' || substr(md5(CAST(v AS VARCHAR)), 1, 8) AS BIGINT) % 6"
        extra = (
            f", (SELECT CAST(max(load) AS BIGINT) FROM (SELECT sum(n) AS load FROM t_{k} GROUP BY {bucket})) * 6 "
            "/ CAST(sum(n) AS BIGINT) AS partition_skew"
            if skew
            else ""
        )
        parts.append(
            f"""SELECT '{k}' AS "key", count(*) AS distinct_keys, max(n) AS largest,
  max(n) / CAST(sum(n) AS BIGINT) AS largest_share{extra} FROM t_{k}"""
        )
    return sql.BASE + ctes + " " + " UNION ALL ".join(parts)


@query(_skew_union(False))
def key_frequencies(spark, sf):
    return key_frequency(sample_events(spark, sf), _KEYS)


@query(_skew_union(True))
def key_partition_skew(spark, sf):
    """With an MD5 bucket instead of the default hash, because SQL has that one too."""
    return key_skew(
        sample_events(spark, sf), _KEYS, 6, lambda v: F.conv(F.substring(F.md5(v), 1, 8), 16, 10).cast("bigint")
    )


@query(f"""{sql.RAW} SELECT event_type, 'old' AS epoch, count(*) AS events, median(payload_size) AS median_size,
  min(payload_size) AS min_size, max(payload_size) AS max_size FROM tagged WHERE reject_reason IS NULL GROUP BY 1""")
def payload_sizes(spark, sf):
    return payload_size_profile(normalize_events(raw_events(sample_events(spark, sf)))[0])


_DISTINCT = ["event_type", "actor_id", "actor_login", "repo_id", "repo_name", "org_id", "language"]


@query(f"""{sql.BASE} SELECT count(*) AS events, max(event_id) AS max_event_id, max(actor_id) AS max_actor_id,
  max(repo_id) AS max_repo_id, max(org_id) AS max_org_id, max(payload_size) AS max_payload_size,
  count(*) FILTER (org_id <> 0) / count(*) AS org_share, count(*) FILTER (language <> '') / count(*) AS language_share,
  {", ".join(f"count(DISTINCT {c}) AS distinct_{c}" for c in _DISTINCT)} FROM canon""")
def columns_exact(spark, sf):
    return column_profile(enriched_events(spark, sf), exact=True)


@query(f"""{sql.BASE} SELECT count(*) AS events, max(event_id) AS max_event_id,
  {", ".join(f"true AS {c}_close" for c in _DISTINCT)} FROM canon""")
def columns_approx(spark, sf):
    events = enriched_events(spark, sf)
    exact = column_profile(events, exact=True).select("events", *[F.col(f"distinct_{c}").alias(c) for c in _DISTINCT])
    both = column_profile(events).join(exact, "events")
    close = [(F.abs(F.col(f"distinct_{c}") - F.col(c)) <= 0.1 * F.col(c)).alias(f"{c}_close") for c in _DISTINCT]
    return both.select("events", "max_event_id", *close)


@query(f"""{sql.BASE} SELECT event_type, count(*) FILTER (ref LIKE 'refs/%') AS qualified,
  count(*) FILTER (ref <> '' AND ref NOT LIKE 'refs/%') AS bare, count(*) FILTER (ref = '') AS without_ref FROM canon GROUP BY 1""")
def ref_forms(spark, sf):
    return ref_form_profile(sample_events(spark, sf))


# Admission ------------------------------------------------------------------------------------------

_WINDOW = 86_400


_ADMISSION_SQL = f"""WITH RECURSIVE req AS MATERIALIZED (
  SELECT event_id AS request_id, user_id AS k, epoch_us(ts) AS us, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 3 END AS lim,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
walk AS (
  SELECT k, rn, request_id, [us] AS held, true AS admitted, CAST(0 AS BIGINT) AS retry_after FROM req WHERE rn = 1
  UNION ALL
  SELECT k, rn, request_id, CASE WHEN len(kept) < lim THEN list_append(kept, us) ELSE kept END, len(kept) < lim,
    CASE WHEN len(kept) < lim THEN 0 ELSE greatest(1, (kept[1] + {_WINDOW}000000 - us) // 1000000 + 1) END
  FROM (SELECT r.*, list_filter(w.held, lambda x: x > r.us - {_WINDOW}000000) AS kept
        FROM walk w JOIN req r ON r.k = w.k AND r.rn = w.rn + 1))
SELECT k AS "key", request_id, admitted, retry_after FROM walk"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a request of its user; even users may do two a day, odd ones three."""
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("key"),
        "ts",
        F.when(F.col("user_id") % 2 == 0, 2).otherwise(3).cast("bigint").alias("limit"),
    )


@query(_ADMISSION_SQL)
def admission(spark, sf):
    return sliding_window_admission(_requests(spark, sf), window_seconds=_WINDOW, order="request_id").select(
        "key", "request_id", "admitted", "retry_after"
    )


@query(_ADMISSION_SQL)
def stream_admission(spark, sf):
    """The same requests as a stream that delivers them in time order, some days per micro-batch."""
    folder, out, checkpoint = (work_dir(spark, name) for name in ("requests", "decisions", "checkpoint"))
    requests = _requests(spark, sf)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        first, last = requests.agg(F.min("ts"), F.max("ts")).first()
        cuts = [None, *(ts_lit(first + (last - first) * part / 4) for part in (1, 2, 3)), None]
        for begin, end in pairwise(cuts):
            arriving = requests
            if begin is not None:
                arriving = arriving.filter(F.col("ts") >= begin)
            if end is not None:
                arriving = arriving.filter(F.col("ts") < end)
            arriving.write.mode("append").parquet(folder)
            (
                admission_stream(spark.readStream.schema(requests.schema).parquet(folder), _WINDOW)
                .writeStream.format("parquet")
                .option("path", out)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(out)
