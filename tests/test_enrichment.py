"""Languages that change, late batches, crashes and replays."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.enrich import enrich_language, unseen_events
from tidemark.operators.equivalence import results_equivalent
from tidemark.operators.rollups import backfill_rollups, language_daily, merge_stored, read_rollup, write_rollups
from tidemark.schema import ACTIVITY, CANONICAL_COLUMNS, LANGUAGE_DAILY, ROLLUP_SCHEMAS
from tidemark.sources import store
from tidemark.sources.dimension import Dimension
from tidemark.sources.store import EVENTS_DDL, batch_load, load_path, read_events, read_table, write_events
from tidemark.streaming.enrichment import MARK, enrich_changed, enrich_months, enriched_versions, languages_of
from tidemark.sources.bus import read_event_stream, to_bus_messages
from tidemark.streaming.ingest import Sinks, fold_finished, replace, start_ingest


def values(spark, **languages):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in languages.items()], "repo_id BIGINT, language STRING")


def as_dict(frame):
    return {r[0]: r[1] for r in frame.collect()}


def test_dimension_versions(spark, tmp_path):
    dimension = Dimension(spark, str(tmp_path / "languages"), "repo_id", "language")
    assert dimension.newest == 0 and dimension.state().count() == 0 and dimension.changes(0, 0).count() == 0
    assert dimension.publish(values(spark, r1="go", r2="c", r3="rust")) == 1
    assert dimension.publish(values(spark, r1="go", r2="c", r3="rust")) == 1  # nothing new
    assert dimension.publish(values(spark, r1="go", r2="zig", r4="ada")) == 2
    assert dimension.publish(values(spark, r2="c"), whole=False) == 3
    assert as_dict(dimension.state()) == {1: "go", 2: "c", 4: "ada"} and as_dict(dimension.state(1)) == {1: "go", 2: "c", 3: "rust"}
    assert as_dict(dimension.changes(1, 2)) == {2: "zig", 3: "", 4: "ada"}
    assert as_dict(dimension.changes(1, 3)) == {3: "", 4: "ada"}  # 2 changed back
    assert as_dict(dimension.changes(0, 3)) == {1: "go", 2: "c", 4: "ada"}
    odd = spark.createDataFrame([(None, "x"), (5, None), (6, "a"), (6, "b")], "repo_id BIGINT, language STRING")
    assert dimension.publish(odd, whole=False) == 4
    assert as_dict(dimension.changes(3, 4)) == {6: "b"}
    assert dimension.publish(odd.limit(0)) == 5 and dimension.state().count() == 0


@pytest.fixture
def filled(spark, event, tmp_path):
    """Three batches over two months and six repositories."""
    sinks = Sinks(str(tmp_path / "out"), stream="s")
    events = event(*[{"created_at": f"2024-0{1 + i % 2}-05 0{i % 7}:00:00", "repo_id": i % 6} for i in range(60)])

    def batch(number):
        rows = events.filter(F.col("event_id") % 3 == number)
        write_events(rows, sinks.events, sinks.load(number))
        write_rollups(rows, sinks.rollups, sinks.load(number))

    return sinks, events, batch


def check(spark, sinks, events, languages):
    wanted = enrich_language(events, languages)
    assert results_equivalent(read_events(spark, sinks.events), wanted)
    days = merge_stored(LANGUAGE_DAILY, read_rollup(spark, sinks.rollups, LANGUAGE_DAILY))
    assert results_equivalent(days, language_daily(wanted).select(*days.columns))
    assert read_rollup(spark, sinks.rollups, ACTIVITY).agg(F.sum("events")).first()[0] == events.count()


def test_only_touched_loads_are_rewritten(spark, filled, tmp_path):
    sinks, events, batch = filled
    languages = languages_of(spark, str(tmp_path / "languages"))
    batch(0)
    batch(1)
    languages.publish(values(spark, r0="go", r1="c", r3="rust"))
    assert enrich_changed(spark, sinks, languages) == [(202401, sinks.load(1)), (202402, sinks.load(1))]
    assert set(enriched_versions(spark, sinks).values()) == {1}
    assert enrich_changed(spark, sinks, languages) == []
    # Repository 1 has events with ids 2, 8, ...: in batch 2 and February only.
    languages.publish(values(spark, r0="go", r1="zig", r3="rust"))
    assert enrich_changed(spark, sinks, languages) == []
    assert set(enriched_versions(spark, sinks).values()) == {2}
    batch(2)
    assert [f for f, v in enriched_versions(spark, sinks).items() if v == 0] == [(202401, sinks.load(2)), (202402, sinks.load(2))]
    assert enrich_changed(spark, sinks, languages, running=True) == []  # the newest batch waits
    assert enrich_changed(spark, sinks, languages) == [(202402, sinks.load(2))]
    check(spark, sinks, events, languages.state())
    # A language that goes away, one that changes in one month only, and a replay of the newest batch.
    languages.publish(values(spark, r0="go", r1="zig", r3="ada"))
    assert enrich_changed(spark, sinks, languages) == [(202402, sinks.load(1))]
    languages.publish(values(spark, r1="zig", r3="ada"))
    assert enrich_changed(spark, sinks, languages) == [(202401, sinks.load(1))]
    batch(2)
    assert enrich_changed(spark, sinks, languages) == [(202402, sinks.load(2))]
    check(spark, sinks, events, languages.state())


@pytest.mark.parametrize("move", [1, 2, 4, 7])
def test_a_crash_anywhere_is_mended_by_the_next_call(spark, filled, tmp_path, monkeypatch, move):
    sinks, events, batch = filled
    languages = languages_of(spark, str(tmp_path / "languages"))
    languages.publish(values(spark, r0="old", r1="old", r5="old"))
    batch(0)
    batch(1)
    enrich_changed(spark, sinks, languages)
    batch(2)
    languages.publish(values(spark, r0="go", r2="c", r3="rust"))
    real, moves = store._move, []

    def crash(session, source, target):
        moves.append(target)
        if len(moves) == move:
            raise RuntimeError("lost")
        real(session, source, target)

    monkeypatch.setattr(store, "_move", crash)
    with pytest.raises(RuntimeError, match="lost"):
        enrich_changed(spark, sinks, languages)
    monkeypatch.undo()
    if move % 2:
        batch(2)  # and Spark runs the newest batch again
    enrich_changed(spark, sinks, languages)
    check(spark, sinks, events, languages.state())


def test_folds_are_enriched_too(spark, filled, tmp_path):
    sinks, events, batch = filled
    languages = languages_of(spark, str(tmp_path / "languages"))
    languages.publish(values(spark, r0="go", r3="c"))
    batch(0)
    enrich_changed(spark, sinks, languages)
    batch(1)
    batch(2)
    fold_finished(spark, sinks, 2)
    enrich_changed(spark, sinks, languages)
    check(spark, sinks, events, languages.state())
    languages.publish(values(spark, r0="zig", r3="c", r4="ada"))
    store.fold_events(spark, sinks.events, sinks.writer, 3)  # ends before the roll-ups are folded
    enrich_changed(spark, sinks, languages)
    check(spark, sinks, events, languages.state())
    fold_finished(spark, sinks, 3)
    check(spark, sinks, events, languages.state())


def test_enriched_months_survive_a_crash_and_a_replay(spark, filled, monkeypatch):
    sinks, events, batch = filled
    for number in range(3):
        batch(number)
    languages = values(spark, r0="go", r1="c", r2="rust")
    for move in (1, 2, 3, 5):
        real, moves = store._move, []

        def crash(session, source, target):
            moves.append(target)
            if len(moves) == move:
                raise RuntimeError("lost")
            real(session, source, target)

        monkeypatch.setattr(store, "_move", crash)
        with pytest.raises(RuntimeError, match="lost"):
            enrich_months(spark, sinks, languages, [202401, 202402])
        monkeypatch.undo()
        enrich_months(spark, sinks, languages, [202401, 202402, 202403])
        check(spark, sinks, events, languages)
        batch(2)
        assert read_events(spark, sinks.events).count() == 60
    enrich_months(spark, sinks, languages, [202401, 202402])
    check(spark, sinks, events, languages)


def test_backfill_by_load_survives_a_replay(spark, filled):
    sinks, events, batch = filled
    for number in range(3):
        batch(number)
    write_rollups(events, sinks.rollups, batch_load("gone", 0))  # sums of a load that the events no longer have
    for _ in range(2):
        backfill_rollups(read_table(spark, sinks.events, EVENTS_DDL), sinks.rollups, [202401, 202402])
        batch(2)
        assert read_rollup(spark, sinks.rollups, ACTIVITY).agg(F.sum("events")).first()[0] == 60
    assert set(ROLLUP_SCHEMAS) == {p.name for p in __import__("pathlib").Path(sinks.rollups).iterdir()}


def test_marks_are_invisible(spark, filled, tmp_path):
    sinks, events, batch = filled
    batch(0)
    languages = languages_of(spark, str(tmp_path / "languages"))
    languages.publish(values(spark, r0="go"))
    enrich_changed(spark, replace(sinks, stream="s"), languages)
    assert f"{MARK}1" in store._files_in(spark, load_path(sinks.events, 202401, sinks.load(0)))
    assert read_events(spark, sinks.events).select(*CANONICAL_COLUMNS).count() == 20


def test_only_unseen_ids_of_overlapping_sources(spark, event, tmp_path):
    path = str(tmp_path / "events")
    events = event(*[{"created_at": f"2024-0{1 + i % 3}-05 00:00:00"} for i in range(30)])
    assert unseen_events(events, path, "x").count() == 30  # nothing is stored yet
    write_events(events.filter("event_id <= 20"), path, "a")
    write_events(unseen_events(events.filter("event_id > 10"), path, "b"), path, "b")
    write_events(unseen_events(events.filter("event_id > 10"), path, "b"), path, "b")  # the load runs again
    assert sorted(r.event_id for r in read_events(spark, path).collect()) == list(range(1, 31))
    assert unseen_events(events, path, "c").count() == 0 and unseen_events(events.limit(0), path, "c").count() == 0
    late = events.filter("event_id = 5").withColumn("event_id", F.lit(99).cast("bigint"))
    frame = unseen_events(late.unionByName(late), path, "c")
    assert frame.count() == 2 and frame.columns == CANONICAL_COLUMNS
    plan = frame._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert filters and all("202402" in f and "202401" not in f for f in filters)


def test_streams_that_overlap_store_each_id_once(spark, event, tmp_path):
    events = event(*[{"created_at": f"2024-0{1 + i % 2}-05 00:00:00"} for i in range(24)])
    sinks = Sinks(str(tmp_path / "out"))
    for number, part in enumerate((events.filter("event_id <= 16"), events.filter("event_id > 8").unionByName(events.filter("event_id = 20")))):
        folder = str(tmp_path / f"messages-{number}")
        places = [F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("key").cast("bigint").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp")]
        to_bus_messages(part).select("key", "value", *places).write.parquet(folder)
        stream = read_event_stream(spark, files=folder)
        checkpoint = str(tmp_path / f"checkpoint-{number}")
        start_ingest(stream, sinks, checkpoint, {"availableNow": True}, beside=bool(number), only_unseen=True).awaitTermination()
    assert sorted(r.event_id for r in read_events(spark, sinks.events).collect()) == list(range(1, 25))
    assert read_rollup(spark, sinks.rollups, ACTIVITY).agg(F.sum("events")).first()[0] == 24
