"""Analytic queries on small hand-made event sets."""

from datetime import date, datetime

import pytest

from tidemark.functions.timestamps import months_between
from tidemark.operators.equivalence import result_differences, result_fingerprint, results_equivalent
from tidemark.operators.filters import in_month, since_day
from tidemark.operators.profiles import (
    column_profile,
    event_type_mix,
    key_skew,
    payload_size_profile,
    ref_form_profile,
)
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
from tidemark.plans.activity import activity_heatmap
from tidemark.plans.cards import repo_card, repo_stars_by_day, repo_stars_total
from tidemark.plans.completeness import completeness_summary, missing_hours, present_hours
from tidemark.plans.corpus import corpus_stats
from tidemark.plans.languages import language_coverage, language_series, language_trends
from tidemark.plans.trending import (
    star_totals,
    star_totals_scan,
    trending,
    trending_by_language,
    trending_hour_aligned,
    trending_page,
    trending_scan,
)
from tidemark.schema import ACTIVITY, LANGUAGE_DAILY, REPO_STARS_HOURLY, ROLLUP_SCHEMAS
from tidemark.sources.store import batch_load

AS_OF = "2024-05-07 10:30:00"


def test_eight_events(eight_events):
    events, stars = eight_events, repo_stars_hourly(eight_events)
    card = repo_card(events, stars, "team/tool").first()
    assert (card.repo_id, card.stars, card.pushes, card.forks, card.issues) == (7, 4, 2, 1, 1)
    assert [(d.date, d.stars) for d in card.stars_by_day] == [(date(2024, 5, 6), 3), (date(2024, 5, 7), 1)]
    coverage = language_coverage(events, AS_OF, "7d").first()
    assert (coverage.known, coverage.total, coverage.coverage) == (1, 8, 0.125)
    series = language_series(language_daily(events), AS_OF).collect()
    assert [(s.language, [(p.date, p.events) for p in s.points]) for s in series] == [("python", [(date(2024, 5, 6), 1)])]
    cells = activity_heatmap(activity_weekday_hour(events)).collect()
    assert sum(c.events for c in cells) == 8
    assert [(c.weekday, c.hour, c.events) for c in cells] == [("monday", 10, 6), ("monday", 11, 1), ("tuesday", 9, 1)]
    for exact in (False, True):
        stats = corpus_stats(events, AS_OF, exact).first()
        assert (stats.events_total, stats.distinct_repos, stats.distinct_actors) == (8, 1, 8)
        assert (stats.oldest, stats.newest) == (datetime(2024, 5, 6, 10), datetime(2024, 5, 7, 9))
        assert stats.ingest_lag_seconds == 5400


def test_empty_input(eight_events):
    none = eight_events.filter("event_id < 0")
    stats = corpus_stats(none, AS_OF).first()
    assert (stats.events_total, stats.oldest, stats.ingest_lag_seconds, stats.distinct_repos) == (0, None, None, 0)
    assert language_coverage(none, AS_OF).first().coverage == 0.0
    assert repo_card(none, repo_stars_hourly(none), "team/tool").isEmpty()
    assert repo_stars_total(repo_stars_hourly(none), 7).first().stars == 0
    assert trending(repo_stars_hourly(none), AS_OF).isEmpty()
    assert column_profile(none).first().org_share is None


def test_card_of_a_repository_without_stars(event):
    events = event({"event_type": "PullRequestEvent"})
    card = repo_card(events, repo_stars_hourly(events), "team/tool").first()
    assert (card.stars, card.pushes, card.stars_by_day) == (0, 0, [])
    assert repo_stars_by_day(repo_stars_hourly(events), 7).isEmpty()


def test_card_goes_by_id_for_stars(event):
    """Stars given under an old name still count for the repository."""
    events = event({"repo_name": "old/name"}, {"repo_name": "team/tool", "event_type": "PushEvent"}, {"repo_id": 8, "repo_name": "x/y"})
    assert repo_card(events, repo_stars_hourly(events), "team/tool").first().stars == 1


@pytest.fixture
def starred(event):
    rows = []
    for repo, count in ((1, 3), (2, 5), (3, 3), (4, 1), (5, 3)):
        rows += [{"repo_id": repo, "repo_name": f"r/{repo}", "created_at": f"2024-05-07 09:{i:02d}:30"} for i in range(count)]
    rows.append({"repo_id": 1, "repo_name": "r/renamed", "created_at": "2024-05-07 10:00:00"})
    rows.append({"repo_id": 4, "repo_name": "r/4", "created_at": "2024-05-06 10:00:00"})  # 24h30m before AS_OF
    rows.append({"repo_id": 4, "repo_name": "r/4", "event_type": "ForkEvent", "created_at": "2024-05-07 10:00:00"})
    return event(*rows)


def top(frame):
    return [(r.repo_id, r.stars) for r in frame.collect()]


def test_trending_variants(starred):
    stars = repo_stars_hourly(starred)
    # The roll-up reaches back to the full hour, the scan does not.
    assert top(trending(stars, AS_OF)) == [(2, 5), (1, 4), (3, 3), (5, 3), (4, 2)]
    assert top(trending_scan(starred, AS_OF)) == [(2, 5), (1, 4), (3, 3), (5, 3), (4, 1)]
    assert top(trending_scan(starred, AS_OF, "1h")) == [(1, 1)]
    assert top(trending(stars, AS_OF, limit=2)) == [(2, 5), (1, 4)]
    names = {r.repo_id: r.repo_name for r in trending(stars, AS_OF).collect()}
    assert names[1] == "r/renamed"
    aligned = trending_hour_aligned(starred, AS_OF)
    assert results_equivalent(trending(stars, AS_OF), aligned)
    fingerprints = [result_fingerprint(f).first() for f in (trending(stars, AS_OF), aligned)]
    assert fingerprints[0] == fingerprints[1] and fingerprints[0].rows == 5
    assert result_differences(trending(stars, AS_OF), trending_scan(starred, AS_OF)).count() == 2


def test_pages_cover_the_list_once(starred):
    stars = repo_stars_hourly(starred)
    seen, after = [], None
    while True:
        page = trending_page(AS_OF, rollup=stars, limit=2, after=after).collect()
        page.sort(key=lambda r: r["rank"])
        seen += [(r["rank"], r.repo_id) for r in page]
        if not page or not page[0].has_next:
            break
        after = (page[-1].stars, page[-1].repo_id, page[-1]["rank"])
    assert seen == [(1, 2), (2, 1), (3, 3), (4, 5), (5, 4)]


def test_language_takes_the_raw_path(event):
    events = event({"language": "go"}, {"language": "go", "repo_id": 8}, {"language": "c"}, {"language": "go"})
    assert top(trending_by_language(events, AS_OF, "go", "7d")) == [(7, 2), (8, 1)]
    page = trending_page(AS_OF, events=events, language="go", window="7d", limit=5).collect()
    assert [(r.repo_id, r["rank"], r.has_next) for r in page] == [(7, 1, False), (8, 2, False)]


@pytest.mark.parametrize("call", [
    lambda e: trending(repo_stars_hourly(e), AS_OF, "2h"),
    lambda e: trending(repo_stars_hourly(e), AS_OF, limit=0),
    lambda e: trending_scan(e, AS_OF, limit=101),
    lambda e: language_trends(language_daily(e), AS_OF, "1d"),
    lambda e: language_coverage(e, AS_OF, "24h"),
])
def test_values_outside_the_domain_are_errors(eight_events, call):
    with pytest.raises(ValueError):
        call(eight_events)


def test_day_window_and_series_order(event):
    events = event(
        {"language": "go", "created_at": "2024-04-30 00:00:00"},
        {"language": "go", "created_at": "2024-04-29 23:59:59"},
        {"language": "c", "created_at": "2024-05-02 01:00:00"},
        {"language": "go", "created_at": "2024-05-02 01:00:00"},
        {"created_at": "2024-05-02 01:00:00"},
    )
    rows = language_trends(language_daily(events), AS_OF, "7d").collect()
    assert [(r.language, r.date.day, r.events) for r in rows] == [("c", 2, 1), ("go", 30, 1), ("go", 2, 1)]


def test_rollup_partials_merge_and_reconcile(spark, starred, tmp_path):
    root = str(tmp_path)
    write_rollups(starred.filter("event_id % 2 = 0"), root, batch_load("s", 0))
    write_rollups(starred.filter("event_id % 2 = 1"), root, batch_load("s", 1))
    write_rollups(starred.filter("event_id % 2 = 1"), root, batch_load("s", 1))  # replay
    whole = {REPO_STARS_HOURLY: repo_stars_hourly(starred), LANGUAGE_DAILY: language_daily(starred), ACTIVITY: activity_weekday_hour(starred)}
    for name in ROLLUP_SCHEMAS:
        assert results_equivalent(merge_stored(name, read_rollup(spark, root, name)), whole[name].select(*read_rollup(spark, root, name).columns))
    stored = {n: read_rollup(spark, root, n) for n in ROLLUP_SCHEMAS}
    assert all(r.difference == 0 for r in reconcile_rollups(starred, stored).collect())
    fold_rollup(spark, root, REPO_STARS_HOURLY, "s", 2)
    rows = read_rollup(spark, root, REPO_STARS_HOURLY)
    assert results_equivalent(rows, whole[REPO_STARS_HOURLY])
    write_rollups(starred, root, "twice")
    doubled = {n: read_rollup(spark, root, n) for n in ROLLUP_SCHEMAS}
    assert {r.rollup: r.difference for r in reconcile_rollups(starred, doubled).collect()}[ACTIVITY] == -starred.count()
    for _ in range(2):
        backfill_rollups(starred, root, [202404, 202405])
    fresh = {n: read_rollup(spark, root, n) for n in ROLLUP_SCHEMAS}
    assert all(r.difference == 0 for r in reconcile_rollups(starred, fresh).collect())


def test_hours_with_gaps(event):
    events = event({"created_at": "2024-05-06 00:30:00"}, {"created_at": "2024-05-06 02:15:00"})
    bounds = ("2024-05-06 00:00:00", "2024-05-06 04:00:00")
    assert [r.hour.hour for r in present_hours(events, *bounds).collect()] == [0, 2]
    assert [r.hour.hour for r in missing_hours(events, *bounds).collect()] == [1, 3]
    summary = completeness_summary(events, *bounds).first()
    assert (summary.total_hours, summary.missing_count) == (4, 2)
    assert summary.missing_hours == [datetime(2024, 5, 6, 1), datetime(2024, 5, 6, 3)]


def test_unaligned_and_empty_ranges(event):
    events = event({"created_at": "2024-05-06 00:10:00"})
    bounds = ("2024-05-06 00:30:00", "2024-05-06 02:15:00")
    assert [r.hour.hour for r in missing_hours(events, *bounds).collect()] == [0, 1]
    assert completeness_summary(events, *bounds).first().total_hours == 1
    backwards = completeness_summary(events, "2024-05-06 05:00:00", "2024-05-06 01:00:00").first()
    assert (backwards.total_hours, backwards.missing_count, backwards.missing_hours) == (0, 0, [])
    aware = missing_hours(events, "2024-05-06T02:00:00+02:00", "2024-05-06T03:00:00+02:00")
    assert aware.isEmpty()


def test_months():
    assert months_between(datetime(2023, 12, 31), datetime(2024, 2, 1)) == [202312, 202401]
    assert months_between(datetime(2024, 2, 1), datetime(2024, 2, 1)) == []


def test_month_and_day_predicates(event):
    events = event({"created_at": "2023-12-31 23:59:59"}, {"created_at": "2024-01-01 00:00:00"}, {"created_at": "2024-12-31 00:00:00"})
    assert [events.filter(in_month(m)).count() for m in (202312, 202401, 202412)] == [1, 1, 1]
    days = language_daily(events.withColumn("language", events.event_type))
    assert days.filter(since_day("2024-01-08 12:00:00", 7)).count() == 2


def test_profiles(event):
    events = event(
        {"event_type": "PushEvent", "ref": "refs/heads/a", "payload_size": 100, "org_id": 3, "created_at": "2025-10-01 15:59:59"},
        {"event_type": "PushEvent", "ref": "b", "payload_size": 201, "created_at": "2025-10-01 16:00:00"},
        {"event_type": "PushEvent", "payload_size": 300, "created_at": "2025-10-15 15:00:00"},
        {"event_type": "PushEvent", "payload_size": 302, "created_at": "2025-10-15 15:00:00"},
        {"language": "c", "created_at": "2025-10-15 14:00:00"},
    )
    mix = event_type_mix(events).collect()
    assert [(r.event_type, r.events, r.share) for r in mix] == [("PushEvent", 4, 0.8), ("WatchEvent", 1, 0.2)]
    assert event_type_mix(events, "2025-10-15 15:20:00").first().events == 2
    sizes = {(r.event_type, r.epoch): (r.events, r.median_size) for r in payload_size_profile(events).collect()}
    assert sizes == {
        ("PushEvent", "old"): (1, 100.0),
        ("PushEvent", "unclear"): (1, 201.0),
        ("PushEvent", "new"): (2, 301.0),
        ("WatchEvent", "unclear"): (1, 20.0),
    }
    forms = {r.event_type: (r.qualified, r.bare, r.without_ref) for r in ref_form_profile(events).collect()}
    assert forms == {"PushEvent": (1, 1, 2), "WatchEvent": (0, 0, 1)}
    for exact in (False, True):
        row = column_profile(events, exact).first()
        assert (row.events, row.distinct_event_type, row.distinct_actor_id, row.max_event_id) == (5, 2, 5, 5)
        assert (row.org_share, row.language_share) == (0.2, 0.2)


def test_skew_controls(spark, event):
    events = event(*[{"repo_id": i % 3} for i in range(60)])
    rows = {r.key: r for r in key_skew(events, ["event_id", "repo_id"], 6).collect()}
    assert rows["constant"].partition_skew == 6.0 and rows["constant"].largest_share == 1.0
    assert rows["event_id"].distinct_keys == 60 and rows["event_id"].partition_skew < 3
    assert rows["repo_id"].largest == 20 and rows["repo_id"].partition_skew >= 2


def test_totals_without_limit_cover_every_repository(event):
    events = event(*[{"repo_id": i, "created_at": "2024-05-06 10:00:00"} for i in range(1, 301)])
    by_rollup = star_totals(repo_stars_hourly(events), "2024-05-07", "7d")
    by_scan = star_totals_scan(events, "2024-05-07", "7d")
    assert by_rollup.count() == 300 and results_equivalent(by_rollup, by_scan)
    assert result_differences(by_rollup, by_scan.filter("repo_id <> 300")).count() == 1
