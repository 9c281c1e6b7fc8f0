"""Canonical messages, dead letters, stored tables."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.enrich import dedup_events, enrich_language
from tidemark.operators.validate import check_messages, poison_messages, valid_events, validate_canonical
from tidemark.schema import CANONICAL_COLUMNS
from tidemark.sources.bus import dead_letter_messages, kafka_options, read_event_stream, to_bus_messages
from tidemark.sources.store import (
    batch_load,
    DEAD_LETTERS,
    EVENT_ORDER,
    EVENTS_DDL,
    finish_replacements,
    fold_batches,
    fold_events,
    drop_month,
    exists,
    month_path,
    read_dead_letters,
    read_events,
    read_table,
    replace_loads,
    replace_month,
    write_dead_letters,
    write_events,
)

GOOD = {
    "event_id": 5,
    "event_type": "PushEvent",
    "created_at": "2024-05-06T10:00:00Z",
    "actor_id": 1,
    "actor_login": "ann",
    "repo_id": 2,
    "repo_name": "a/b",
    "org_id": 0,
    "language": "",
    "payload_size": 176,
    "ref": "refs/heads/main",
}


def messages(spark, values):
    rows = [(f"k{i}", v, 3, 100 + i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key STRING, value STRING, partition INT, offset BIGINT")


def test_round_trip(spark, eight_events):
    sent = to_bus_messages(eight_events)
    first = sent.filter("key = '1'").first()
    assert first.value == (
        '{"event_id":1,"event_type":"WatchEvent","created_at":"2024-05-06T10:00:00Z","actor_id":1,'
        '"actor_login":"user1","repo_id":7,"repo_name":"team/tool","org_id":0,"language":"python","payload_size":20,"ref":""}'
    )
    assert sent.columns == ["key", "value"]
    placed = sent.withColumns({"partition": F.lit(0), "offset": F.col("key").cast("bigint")})
    events, poison = validate_canonical(placed)
    assert events.exceptAll(eight_events).isEmpty() and events.count() == 8
    assert poison.isEmpty()


POISON = {
    "not json": "not a JSON object",
    "": "not a JSON object",
    "{}": "event_id is missing",
    "[]": "not a JSON object",
    "5": "not a JSON object",
    json.dumps(GOOD) + " tail": "not a JSON object",
    json.dumps(GOOD) + "," + json.dumps(GOOD): "not a JSON object",
    json.dumps({**GOOD, "event_type": ""}): "event_type is empty",
    json.dumps({**GOOD, "created_at": "0001-01-01T00:00:00Z"}): "zero time",
    json.dumps({**GOOD, "created_at": "yesterday"}): "not a timestamp",
    json.dumps({**GOOD, "actor_id": None}): "actor_id is missing",
    json.dumps({**GOOD, "actor_id": "1"}): "actor_id is not an integer",
    json.dumps({**GOOD, "payload_size": 1.5}): "payload_size is not an integer",
    json.dumps({**GOOD, "repo_name": 4}): "repo_name is not a string",
    json.dumps({k: v for k, v in GOOD.items() if k != "ref"}): "ref is missing",
}


def test_split_keeps_good_messages_and_their_order(spark):
    values = [json.dumps(GOOD), *POISON, json.dumps({**GOOD, "event_id": 6})]
    checked = check_messages(messages(spark, values))
    events = valid_events(checked, with_place=True).orderBy("partition", "offset").collect()
    assert [e.event_id for e in events] == [5, 6]
    assert events[0].created_at == datetime(2024, 5, 6, 10)
    letters = poison_messages(checked).orderBy("source_offset").collect()
    assert [letter.value for letter in letters] == list(POISON)
    for letter in letters:
        assert POISON[letter.value] in letter.error, letter
        assert letter.source_partition == 3 and letter.key == f"k{letter.source_offset - 100}"


def test_null_value_is_poison(spark):
    letters = poison_messages(check_messages(messages(spark, [None])))
    assert [r.error for r in letters.collect()] == ["value is not a JSON object"]


def test_dead_letter_headers(spark):
    letters = poison_messages(check_messages(messages(spark, ["{}"])))
    row = dead_letter_messages(letters).first()
    assert (row.key, row.value) == ("k0", "{}")
    headers = {h.key: bytes(h.value).decode() for h in row.headers}
    assert headers == {
        "x-error": "event_id is missing",
        "x-error-type": "PoisonMessageError",
        "x-source-partition": "3",
        "x-source-offset": "100",
    }


def test_dead_letters_stored_once_per_load(spark, tmp_path):
    letters = poison_messages(check_messages(messages(spark, ["{}", "x"])))
    path = str(tmp_path / "dlq")
    for load in ("a", "a", "b"):
        write_dead_letters(letters, path, load)
    assert read_dead_letters(spark, path).count() == 4


def test_kafka_contract():
    options = kafka_options("broker:9092", "events")
    assert options["startingOffsets"] == "earliest" and options["failOnDataLoss"] == "true"
    assert "maxOffsetsPerTrigger" not in options


def test_stream_source_needs_exactly_one_origin(spark):
    with pytest.raises(ValueError):
        read_event_stream(spark)


def test_store_append_reload_and_range(spark, event, tmp_path):
    path = str(tmp_path / "events")
    rows = event(
        {"created_at": "2024-01-31 23:59:59"},
        {"created_at": "2024-02-01 00:00:00"},
        {"created_at": "2024-02-10 00:00:00", "event_type": "PushEvent"},
        {"created_at": "2024-03-01 00:00:00"},
    )
    write_events(rows, path, "first")
    write_events(rows, path, "first")
    assert read_events(spark, path).count() == 4
    write_events(rows, path)  # a plain append: duplicates are allowed
    assert read_events(spark, path).count() == 8
    ids = [r.event_id for r in read_events(spark, path, "2024-02-01", "2024-03-01").collect()]
    assert sorted(ids) == [2, 2, 3, 3]
    assert read_events(spark, path).columns == CANONICAL_COLUMNS
    assert read_events(spark, path, "2024-03-01", "2024-02-01").count() == 0


def test_range_read_prunes_months_and_pushes_the_bounds(spark, event, tmp_path):
    path = str(tmp_path / "events")
    write_events(event({"created_at": "2024-01-31 10:00:00"}, {"created_at": "2024-02-01 10:00:00"}), path, "a")
    frame = read_events(spark, path, "2024-02-01", "2024-02-02").filter("event_type = 'WatchEvent'")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ym#" in plan.split("PartitionFilters")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "created_at" in pushed and "EqualTo(event_type,WatchEvent)" in pushed


def test_drop_replace_and_compact_month(spark, event, tmp_path):
    path = str(tmp_path / "events")
    january = event({"created_at": "2024-01-05 00:00:00"}, {"created_at": "2024-01-06 00:00:00"})
    february = event({"created_at": "2024-02-05 00:00:00"})
    for load in ("a", "b"):
        write_events(january, path, load)
    write_events(february, path, "c")
    replace_month(january, path, 202401, "reload", ["event_type"], ["event_type"], ["repo_name"])
    assert exists(spark, f"{month_path(path, 202401)}/load=reload")
    assert not exists(spark, f"{month_path(path, 202401)}/load=a")
    assert read_events(spark, path).count() == 3
    drop_month(spark, path, 202401)
    assert [r.created_at for r in read_events(spark, path).collect()] == [datetime(2024, 2, 5)]


def folders(path):
    return sorted(p.name for p in Path(path).glob("ym=*/load=*"))


def test_a_rerun_removes_months_it_no_longer_fills(spark, event, tmp_path):
    path = str(tmp_path / "events")
    rows = event({"created_at": "2024-01-05 00:00:00"}, {"created_at": "2024-02-05 00:00:00"})
    write_events(rows, path, "a")
    write_events(rows, path, "b")
    write_events(rows.filter("event_id = 1"), path, "a")
    assert read_events(spark, path).count() == 3 and folders(path) == ["load=a", "load=b", "load=b"]


def test_folding_keeps_later_loads_and_resumes_after_a_crash(spark, event, tmp_path, monkeypatch):
    from tidemark.sources import store

    path = str(tmp_path / "events")
    rows = event({}, {})
    for batch in range(6):
        write_events(rows, path, batch_load("s", batch))
    write_events(rows, path, "archive-x")

    real, moves = store._move, []

    def crash(session, source, target):
        moves.append(target)
        if len(moves) == 2:  # the worst moment: what was folded is gone, the fold not yet in its place
            raise RuntimeError("lost")
        real(session, source, target)

    monkeypatch.setattr(store, "_move", crash)
    with pytest.raises(RuntimeError):
        fold_events(spark, path, "s", 5)
    monkeypatch.undo()
    write_events(rows, path, batch_load("s", 6))
    write_events(rows, path, batch_load("s", 5))  # a replay of a batch that was not folded
    fold_events(spark, path, "s", 5)
    assert read_events(spark, path).count() == 16
    assert len(folders(path)) == 4
    fold_events(spark, path, "s", 7)
    assert read_events(spark, path).count() == 16 and len(folders(path)) == 2


def test_many_batches_fold_to_one_folder_a_month(spark, event, tmp_path):
    path = str(tmp_path / "letters")
    letters = spark.createDataFrame([("k", "v", "e", "t", 0, 1)], DEAD_LETTERS)
    for batch in range(12):
        write_dead_letters(letters, path, batch_load("s", batch))
    fold_batches(spark, path, DEAD_LETTERS, "s", 11, ["source_offset"], ["source_partition"])
    assert read_dead_letters(spark, path).count() == 12 and len(folders(path)) == 2


def test_no_dead_letters_are_no_rows(spark, tmp_path):
    assert read_dead_letters(spark, str(tmp_path / "none")).count() == 0
    path = str(tmp_path / "empty")
    write_dead_letters(spark.createDataFrame([], DEAD_LETTERS), path, "a")
    assert read_dead_letters(spark, path).count() == 0


def test_dedup(spark, event):
    rows = event({}, {}, {})
    again = rows.filter("event_id < 3")
    other_copy = again.withColumn("payload_size", F.lit(99).cast("bigint"))
    result = dedup_events(rows.unionByName(again).unionByName(other_copy))
    assert sorted((r.event_id, r.payload_size) for r in result.collect()) == [(1, 20), (2, 20), (3, 20)]


def test_enrichment_never_multiplies_events(spark, event):
    events = event({"repo_id": 1}, {"repo_id": 2}, {"repo_id": 1})
    lookup = spark.createDataFrame([(1, "go"), (1, "c"), (9, "rust")], "repo_id BIGINT, language STRING")
    rows = enrich_language(events, lookup).orderBy("event_id").collect()
    assert [r.language for r in rows] == ["go", "", "go"]
    assert enrich_language(events, lookup).columns == CANONICAL_COLUMNS


# Replays, crashes and many foreign loads -----------------------------------------------------------------


def crash_at(monkeypatch, move):
    """Let the given `_move` of the store fail, as a lost driver would."""
    from tidemark.sources import store

    real, moves = store._move, []

    def crash(session, source, target):
        moves.append(target)
        if len(moves) == move:
            raise RuntimeError("lost")
        real(session, source, target)

    monkeypatch.setattr(store, "_move", crash)


@pytest.mark.parametrize("move", [1, 2])
def test_a_replaced_month_survives_a_crash_and_a_replay(spark, event, tmp_path, monkeypatch, move):
    path = str(tmp_path / "events")
    rows = event(*[{"created_at": f"2024-0{1 + i % 2}-05 00:00:00"} for i in range(20)])
    for batch in range(4):
        write_events(rows.filter(f"event_id % 4 = {batch}"), path, batch_load("s", batch))

    def replace():
        january = read_table(spark, path, EVENTS_DDL, [202401]).select(*CANONICAL_COLUMNS)
        replace_month(january.withColumn("language", F.lit("go")), path, 202401, "reload", EVENT_ORDER, ["event_type"])

    crash_at(monkeypatch, move)
    with pytest.raises(RuntimeError):
        replace()
    monkeypatch.undo()
    if move == 2:  # the month lay beside the table when its rows were read
        with pytest.raises(RuntimeError, match="read the rows again"):
            replace()
    replace()
    assert read_events(spark, path).count() == 20
    write_events(rows.filter("event_id % 4 = 3"), path, batch_load("s", 3))  # Spark runs the newest batch again
    assert read_events(spark, path).count() == 20
    assert read_events(spark, path).filter("language = 'go'").count() == 10
    write_events(rows.filter("event_id % 4 = 0"), path, batch_load("s", 4))  # a new batch of that month counts
    assert read_events(spark, path).count() == 25
    replace()
    fold_events(spark, path, "s", 4)
    assert read_events(spark, path).count() == 25


def test_what_is_loaded_after_a_crash_is_kept(spark, event, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    write_events(event({}, {}), path, "a")
    write_events(event({}), path, "b")
    folders = [(202405, "a")]
    rewritten = read_table(spark, path, EVENTS_DDL, [202405]).filter("load = 'a'").withColumn("ref", F.lit("x"))
    crash_at(monkeypatch, 2)
    with pytest.raises(RuntimeError):
        replace_loads(rewritten, path, folders, EVENT_ORDER, [])
    monkeypatch.undo()
    write_events(event({}, {}, {}), path, "a")  # the load comes again, with more rows
    finish_replacements(spark, path)
    assert read_events(spark, path).count() == 4 and read_events(spark, path).filter("ref = 'x'").count() == 0


def test_writes_look_up_their_own_folders_only(spark, event, tmp_path, monkeypatch):
    from tidemark.sources import store

    path = tmp_path / "events"
    write_events(event({}), str(path), batch_load("s", 0))
    for number in range(1000):
        (path / "ym=202405" / f"load=foreign-{number:04d}").mkdir()
    looked, real = [], store._files_in
    monkeypatch.setattr(store, "_files_in", lambda session, folder: looked.append(folder) or real(session, folder))
    monkeypatch.setattr(store, "month_loads", lambda *_: pytest.fail("lists the loads of a month"))
    write_events(event({}), str(path), batch_load("s", 1))
    assert len(looked) == 2 and all("foreign" not in folder for folder in looked)
    assert read_events(spark, str(path)).count() == 2


def test_stored_dead_letters_are_checked_once(spark, monkeypatch):
    from tidemark.samples import catalog

    seen, real = spark.sparkContext.accumulator(0), catalog.bus_messages

    @F.udf("string")
    def counted(key):
        seen.add(1)
        return key

    monkeypatch.setattr(
        catalog, "bus_messages", lambda events: real(events).withColumn("key", counted.asNondeterministic()("key"))
    )
    sf = "/root/testdata/sf0.001"
    letters = catalog.store_dead_letters(spark, sf).count()
    assert 0 < letters and seen.value == spark.read.parquet(f"{sf}/events.parquet").count()
