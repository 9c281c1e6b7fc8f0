"""Properties of the physical plans that only matter on large data, checked on small data."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.enrich import enrich_language
from tidemark.operators.rollups import read_rollup, write_rollups
from tidemark.plans.cards import repo_card
from tidemark.plans.completeness import completeness_summary, missing_hours
from tidemark.plans.languages import language_coverage
from tidemark.plans.trending import trending, trending_by_language, trending_scan
from tidemark.samples import catalog
from tidemark.schema import CANONICAL_COLUMNS, REPO_STARS_HOURLY
from tidemark.sources.store import read_events, write_events


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def set_all(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            before[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot_events(spark):
    """60 000 events, a third of them on one repository."""
    n = F.col("id")
    hot = n % 3 == 0
    return spark.range(60_000).select(
        n.alias("event_id"),
        F.when(n % 10 < 7, "PushEvent").otherwise("WatchEvent").alias("event_type"),
        F.expr("TIMESTAMP_NTZ '2024-05-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id * 40 AS DECIMAL(18,6)))").alias("created_at"),
        (n % 500).alias("actor_id"),
        F.concat(F.lit("user"), n % 500).alias("actor_login"),
        F.when(hot, 1).otherwise(n % 900 + 2).cast("bigint").alias("repo_id"),
        F.sha2(F.when(hot, 1).otherwise(n % 900 + 2).cast("string"), 256).alias("repo_name"),
        F.lit(0).cast("bigint").alias("org_id"),
        F.lit("").alias("language"),
        F.xxhash64(n).bitwiseAND(1023).alias("payload_size"),
        F.sha2(n.cast("string"), 256).alias("ref"),
    ).select(*CANONICAL_COLUMNS)


@pytest.mark.parametrize("unique", [True, False])
def test_hot_repository_is_split_in_the_language_join(spark, conf, hot_events, unique):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="200KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="400KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__shuffle__partitions="16",
    )
    lookup = spark.range(1, 1000).select(F.col("id").alias("repo_id"), F.lit("go").alias("language"))
    joined = enrich_language(hot_events.repartition(8), lookup, unique)
    plan = final_plan(joined)
    assert "skew=true" in plan and "BroadcastHashJoin" not in plan
    assert joined.filter("language = 'go'").count() == 60_000


def test_a_large_month_is_written_by_several_tasks_in_sorted_files(spark, conf, hot_events, tmp_path):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="500KB")
    path = str(tmp_path / "events")
    write_events(hot_events.repartition(8), path, "a")
    files = read_events(spark, path).filter("event_type = 'PushEvent'").select(F.input_file_name().alias("f"))
    per_file = [r["count"] for r in files.groupBy("f").count().collect()]
    assert len(per_file) > 2 and max(per_file) < 30_000 and sum(per_file) == 42_000
    one = spark.read.parquet(files.first().f).select("event_type", "created_at", "repo_id")
    rows = [tuple(r) for r in one.collect()]
    assert rows == sorted(rows)


def test_stored_rollup_answers_with_one_shuffle(spark, hot_events, tmp_path):
    write_rollups(hot_events, str(tmp_path), "a")
    frame = trending(read_rollup(spark, str(tmp_path), REPO_STARS_HOURLY), "2024-05-20", "7d")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "TakeOrderedAndProject" in plan
    assert "GreaterThanOrEqual(hour" in plan
    by_scan = trending_scan(hot_events, "2024-05-20", "7d")
    assert by_scan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_the_size_of_a_range_does_not_choose_the_plan(hot_events):
    def plan(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()

    for start in ("2024-01-01", "1990-01-01"):
        assert "strategy=broadcast" not in plan(missing_hours(hot_events, start, "2024-02-01"))


def test_queries_on_stored_events_skip_months_and_push_the_id(spark, hot_events, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    path, root = str(tmp_path / "events"), str(tmp_path / "rollups")
    write_events(hot_events, path, "a")
    write_rollups(hot_events, root, "a")
    stored = read_events(spark, path, with_month=True)
    as_of = "2024-05-20"
    for frame in (
        trending_scan(stored, as_of), trending_by_language(stored, as_of, "go"), language_coverage(stored, as_of, "7d"),
        missing_hours(stored, "2024-05-01", "2024-05-20"), completeness_summary(stored, "2024-05-01", "2024-05-20"),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "(ym#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    card = repo_card(stored, read_rollup(spark, root, REPO_STARS_HOURLY), "a/b")
    plan = card._jdf.queryExecution().executedPlan().toString()
    assert any("repo_id" in part.split("]")[0] for part in plan.split("DataFilters: [")[1:])


LAZY = [
    n for n in catalog.QUERIES
    if not n.startswith(("store_", "stream_", "backfill_", "compact_", "archive_", "page_", "enrich_stored"))
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_single_task_sort_of_raw_rows(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
