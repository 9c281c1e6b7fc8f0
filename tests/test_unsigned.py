"""Ids over the whole unsigned 64-bit range."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.unsigned import as_bits, in_order, largest, of_digits, of_number, to_decimal, to_text
from tidemark.operators.enrich import dedup_events
from tidemark.operators.filters import after_keyset
from tidemark.operators.normalize import normalize_events
from tidemark.operators.profiles import column_profile
from tidemark.operators.rollups import merge_stored, repo_stars_hourly
from tidemark.operators.validate import check_messages, poison_messages, valid_events
from tidemark.plans.cards import repo_lookup, repo_stars_total
from tidemark.plans.trending import trending, trending_page
from tidemark.schema import CORRUPT, RAW, REPO_STARS_HOURLY
from tidemark.sources.bus import to_bus_messages
from tidemark.sources.store import read_events, write_events

TOP = 1 << 63
NUMBERS = [0, 1, 7, TOP - 1, TOP, TOP + 1, 2 * TOP - 1]


def test_bits_order_and_text(spark):
    frame = spark.createDataFrame([(as_bits(n),) for n in reversed(NUMBERS)], "id BIGINT")
    rows = frame.orderBy(in_order("id")).select(to_decimal("id").alias("d"), to_text("id").alias("t"), in_order(in_order("id")).alias("b")).collect()
    assert [int(r.d) for r in rows] == NUMBERS and [r.t for r in rows] == [str(n) for n in NUMBERS]
    assert [r.b for r in rows] == [as_bits(n) for n in NUMBERS]
    assert frame.agg(largest("id").alias("m")).first().m == -1
    assert frame.limit(0).agg(largest("id").alias("m")).first().m is None
    for bad in (-TOP - 1, 2 * TOP):
        with pytest.raises(ValueError):
            as_bits(bad)


def test_digits_and_numbers(spark):
    texts = {str(n): as_bits(n) for n in NUMBERS} | {"007": 7, "0" * 30 + "5": 5}
    texts |= dict.fromkeys(["", "-1", "+1", " 1", "1.0", "x", str(2 * TOP), "9" * 25, "9" * 60])
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert {r.t: r.n for r in frame.select("t", of_digits(F.col("t")).alias("n")).collect()} == texts
    numbers = {str(n): as_bits(n) for n in NUMBERS}
    numbers |= dict.fromkeys(["-1", "1.5", "1.0", "1e2", '"5"', "null", "true", "{}", "[1]", str(2 * TOP), str(-TOP - 5), "9" * 40])
    frame = spark.createDataFrame([(t,) for t in numbers], "t STRING")
    assert {r.t: r.n for r in frame.select("t", of_number(F.parse_json("t")).alias("n")).collect()} == numbers


def raw_line(event, actor, repo, org):
    return (
        f'{{"id":"{event}","type":"WatchEvent","created_at":"2024-05-06T10:00:00Z","actor":{{"id":{actor},"login":"a"}},'
        f'"repo":{{"id":{repo},"name":"b/c"}},"org":{{"id":{org}}}}}'
    )


def test_normalise_and_validate(spark):
    big = 2 * TOP - 1
    lines = [raw_line(TOP, TOP + 1, big, TOP - 1), raw_line(2 * TOP, 1, 1, 1), raw_line(5, 2 * TOP, 1, 1), raw_line(5, 1, -1, 1)]
    raw = spark.createDataFrame([(x,) for x in lines], "line STRING").select(F.from_json("line", RAW, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    events, rejects = normalize_events(raw.select("r.*"))
    row = events.first()
    assert (row.event_id, row.actor_id, row.repo_id, row.org_id) == tuple(as_bits(n) for n in (TOP, TOP + 1, big, TOP - 1))
    assert sorted(r.reject_reason for r in rejects.collect()) == ["bad_id", "wrong_field_type", "wrong_field_type"]
    messages = to_bus_messages(events)
    sent = messages.first()
    assert sent.key == str(TOP) and f'"repo_id":{big},' in sent.value
    places = [F.lit(None).cast(t).alias(c) for c, t in (("partition", "int"), ("offset", "bigint"))]
    bad = messages.select("key", F.regexp_replace("value", f'"repo_id":{big}', f'"repo_id":{2 * TOP}').alias("value"))
    checked = check_messages(messages.unionByName(bad).select("*", *places))
    assert [r.asDict() for r in valid_events(checked).collect()] == [row.asDict()]
    assert [r.error for r in poison_messages(checked).collect()] == ["repo_id is not an integer"]


def test_order_where_it_matters(spark, event, tmp_path):
    names = [(5, "old/name"), (TOP + 5, "new/name"), (TOP - 1, "mid/name")]
    events = event(*[{"event_id": as_bits(i), "repo_id": as_bits(TOP + 9), "repo_name": n} for i, n in names])
    row = repo_stars_hourly(events).first()
    assert (row.repo_name, row.last_event_id) == ("new/name", as_bits(TOP + 5))
    parts = repo_stars_hourly(events.filter("event_id > 0")).unionByName(repo_stars_hourly(events.filter("event_id < 0")))
    assert merge_stored(REPO_STARS_HOURLY, parts).first().repo_name == "new/name"
    assert column_profile(events).first().max_event_id == as_bits(TOP + 5)
    assert column_profile(events, exact=True).first().max_event_id == as_bits(TOP + 5)
    assert repo_stars_total(repo_stars_hourly(events), TOP + 9).first().stars == 3
    assert repo_lookup(events, "new/name").first().repo_id == as_bits(TOP + 9)
    copies = dedup_events(events.unionByName(events))
    assert copies.count() == 3
    path = str(tmp_path / "events")
    write_events(events, path, "a")
    assert read_events(spark, path).filter(F.col("repo_id") == as_bits(TOP + 9)).count() == 3


def test_paging_by_unsigned_ids(event):
    ids = [3, TOP - 1, TOP, 2 * TOP - 1]
    stars = repo_stars_hourly(event(*[{"repo_id": as_bits(i)} for i in ids]))
    as_of = datetime(2024, 5, 6, 12)
    assert [r.repo_id for r in trending(stars, as_of).collect()] == [as_bits(i) for i in ids]
    page = trending_page(as_of, rollup=stars, limit=2).orderBy("rank").collect()
    assert [r.repo_id for r in page] == [3, TOP - 1]
    for last in (TOP - 1, as_bits(TOP - 1)):
        rest = trending_page(as_of, rollup=stars, limit=2, after=(1, last, 2)).orderBy("rank").collect()
        assert [(r.repo_id, r.rank) for r in rest] == [(as_bits(TOP), 3), (-1, 4)]
    assert stars.filter(after_keyset("stars", "repo_id", (1, TOP))).count() == 1
