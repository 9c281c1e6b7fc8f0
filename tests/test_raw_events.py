"""Archive lines and live pages down to canonical rows."""

import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators.normalize import (
    normalize_events,
    observe_rejects,
    payload_epoch,
    reject_counts,
    tag_events,
    usable,
)
from tidemark.schema import CANONICAL
from tidemark.sources.archive import MAX_LINE_BYTES, hour_path, hour_range, parse_hour, read_archive
from tidemark.sources.pages import read_event_pages, split_page


def sized(prefix: str, size: int, suffix: str = "") -> str:
    """A payload object padded to an exact number of UTF-8 bytes."""
    head, tail = "{" + prefix + '"pad":"', '"' + suffix + "}"
    return head + "x" * (size - len((head + tail).encode())) + tail


def raw(number: int, kind: str, payload: str | None, org: int | None = None, **replace: str) -> str:
    fields = {
        "id": f'"{number}"',
        "type": f'"{kind}"',
        "actor": f'{{"id": {number + 100}, "login": "user{number}", "avatar_url": "https://example.org/a"}}',
        "repo": f'{{"id": {number + 200}, "name": "team/tool{number}", "url": "https://example.org/r"}}',
        "payload": payload,
        "public": "true",
        "created_at": '"2024-06-03T15:00:0%dZ"' % (number % 10),
        "org": f'{{"id": {org}, "login": "team"}}' if org else None,
        **replace,
    }
    return "{" + ", ".join(f'"{k}":{v}' for k, v in fields.items() if v is not None) + "}"


OLD_PUSH = sized(
    '"push_id": 1, "size": 1, "distinct_size": 1, "ref":"refs/heads/master", "commits":[{"message":"done \U0001f600"}], ', 479
)
GOLDEN = [
    (raw(1, "PushEvent", sized('"push_id":1,"ref":"refs/heads/main",', 176)), 0, 176, "refs/heads/main"),
    (raw(2, "PushEvent", sized('"push_id":2,"ref":"refs/heads/issue-9",', 217), org=77), 77, 217, "refs/heads/issue-9"),
    (raw(3, "CreateEvent", sized('"ref":"main","ref_type":"branch",', 143)), 0, 143, "main"),
    (raw(4, "DeleteEvent", sized('"ref":"backport-1",', 126)), 0, 126, "backport-1"),
    (raw(5, "WatchEvent", '{"action":"started"}'), 0, 20, ""),
    (raw(6, "ForkEvent", sized('"forkee": {"id": 5 }, "ref":"ignored",', 5428), org=88), 88, 5428, ""),
    (raw(7, "PushEvent", OLD_PUSH), 0, 479, "refs/heads/master"),
]


@pytest.fixture
def archive(tmp_path):
    def write(hour: str, lines: list[str]) -> str:
        with gzip.open(hour_path(str(tmp_path), parse_hour(hour)), "wt", encoding="utf-8") as out:
            out.write("\n".join(lines) + "\n")
        return str(tmp_path)

    return write


def test_golden_hour(spark, archive):
    base = archive("2024-06-03-15", [line for line, *_ in GOLDEN])
    events, rejects = normalize_events(read_archive(spark, base, "2024-06-03-15"))
    rows = events.orderBy("event_id").collect()
    assert [(r.org_id, r.payload_size, r.ref) for r in rows] == [tuple(g[1:]) for g in GOLDEN]
    assert rows[0].created_at == datetime(2024, 6, 3, 15, 0, 1)
    assert (rows[0].actor_id, rows[0].actor_login, rows[0].repo_id, rows[0].repo_name) == (101, "user1", 201, "team/tool1")
    assert rows[0].language == ""
    assert rejects.count() == 0


def test_payload_epochs(spark, archive):
    base = archive("2024-06-03-15", [line for line, *_ in GOLDEN])
    lines = read_archive(spark, base, "2024-06-03-15")
    epochs = lines.select(payload_epoch(lines).alias("e")).groupBy("e").count().collect()
    assert {r.e: r["count"] for r in epochs} == {"old": 1, "new": 2, "": 4}


REJECTS = {
    '{"id":"9","type":"WatchEvent","crea': "malformed_json",
    "5": "malformed_json",
    raw(1, "WatchEvent", None, id='"abc"'): "bad_id",
    raw(1, "WatchEvent", None, id='"-1"'): "bad_id",
    raw(1, "WatchEvent", None, id='" 1 "'): "bad_id",
    raw(1, "WatchEvent", None, id='"+5"'): "bad_id",
    raw(1, "WatchEvent", None, id='"99999999999999999999"'): "bad_id",
    raw(1, "WatchEvent", None, id="null"): "bad_id",
    raw(1, "WatchEvent", None, id="5"): "wrong_field_type",
    raw(1, "WatchEvent", None, type="7"): "wrong_field_type",
    raw(1, "", None): "no_type",
    raw(1, "WatchEvent", None, type="null"): "no_type",
    raw(1, "WatchEvent", None, created_at="null"): "no_created_at",
    raw(1, "WatchEvent", None, created_at='"0001-01-01T00:00:00Z"'): "no_created_at",
    raw(1, "WatchEvent", None, created_at='"2024-02-30T00:00:00Z"'): "wrong_field_type",
    raw(1, "WatchEvent", None, created_at='"2024-02-03"'): "wrong_field_type",
    raw(1, "WatchEvent", None, created_at="17"): "wrong_field_type",
    raw(1, "WatchEvent", None, actor="3"): "wrong_field_type",
    raw(1, "WatchEvent", None, actor='{"id": -3, "login": "a"}'): "wrong_field_type",
    raw(1, "WatchEvent", None, actor='{"id": 1.5, "login": "a"}'): "wrong_field_type",
    raw(1, "WatchEvent", None, actor='{"id": 1, "login": 4}'): "wrong_field_type",
    raw(1, "WatchEvent", None, repo='{"id": "1", "name": "a/b"}'): "wrong_field_type",
    raw(1, "WatchEvent", None, org="[]"): "wrong_field_type",
    '{"id":"9"}': "no_type",
}


def test_reject_reasons(spark, archive):
    base = archive("2024-06-03-9", list(REJECTS))
    tagged = tag_events(read_archive(spark, base, "2024-06-03-9"))
    wanted: dict[str, int] = {}
    for reason in REJECTS.values():
        wanted[reason] = wanted.get(reason, 0) + 1
    assert {r.reject_reason: r.rejected for r in reject_counts(tagged).collect()} == wanted
    assert usable(tagged).count() == 0


def test_accepted_variants(spark, archive):
    lines = [
        raw(1, "WatchEvent", "null"),
        raw(2, "WatchEvent", None),
        raw(3, "ForkEvent", '{"ref":"x"}'),
        raw(4, "PushEvent", '{"ref": 5}'),
        raw(5, "PushEvent", '{"ref":null}'),
        raw(6, "PushEvent", "[1, 2]"),
        raw(7, "WatchEvent", "{}", actor="null", repo="null", org="null"),
        raw(8, "WatchEvent", "{}", created_at='"2024-06-03T17:00:00.75+02:00"'),
        "",
    ]
    base = archive("2024-06-03-15", lines)
    events, rejects = normalize_events(read_archive(spark, base, "2024-06-03-15"))
    rows = {r.event_id: r for r in events.collect()}
    assert rejects.count() == 0 and len(rows) == 8
    assert [rows[i].payload_size for i in range(1, 7)] == [0, 0, 11, 10, 12, 6]
    assert all(rows[i].ref == "" for i in rows)
    assert (rows[7].actor_id, rows[7].actor_login, rows[7].repo_id, rows[7].repo_name, rows[7].org_id) == (0, "", 0, "", 0)
    assert rows[8].created_at == datetime(2024, 6, 3, 15, 0, 0)


def test_broken_line_is_skipped_and_counted_in_the_same_pass(spark, archive, tmp_path):
    base = archive("2024-06-03-15", [GOLDEN[0][0], "{broken", GOLDEN[4][0]])
    counters = Observation("rejects")
    tagged = observe_rejects(tag_events(read_archive(spark, base, "2024-06-03-15")), counters)
    assert usable(tagged).count() == 2
    assert counters.get["seen"] == 3 and counters.get["malformed_json"] == 1


def test_missing_hour_and_bad_gzip_are_fatal(spark, archive, tmp_path):
    base = archive("2024-06-03-15", [GOLDEN[0][0]])
    with pytest.raises(AnalysisException):
        read_archive(spark, base, "2024-06-03-15", "2024-06-03-17").count()
    (tmp_path / "2024-06-03-16.json.gz").write_bytes(b"\x1f\x8bnot gzip at all")
    with pytest.raises(Exception):
        usable(tag_events(read_archive(spark, base, "2024-06-03-15", "2024-06-03-17"))).collect()


def test_oversized_line_is_fatal(spark, archive):
    base = archive("2024-06-03-15", [raw(1, "PushEvent", '{"x":"' + "y" * MAX_LINE_BYTES + '"}')])
    with pytest.raises(Exception, match="longer than"):
        usable(tag_events(read_archive(spark, base, "2024-06-03-15"))).collect()


def test_hours():
    assert hour_path("/a/", parse_hour("2026-06-01-9")) == "/a/2026-06-01-9.json.gz"
    assert len(hour_range("2026-06-01-0", "2026-06-02-0")) == 24
    assert hour_range("2024-02-28-23", "2024-02-29-1") == [datetime(2024, 2, 28, 23), datetime(2024, 2, 29, 0)]
    for bad in ("2026-06-01", "2026-06-01-24", "2026-13-01-0", "2026-02-30-0", "2026-06-01-x", "2026-06-01-0-0", "a-b-c-d"):
        with pytest.raises(ValueError):
            parse_hour(bad)
    for start, end in (("2026-06-01-5", "2026-06-01-5"), ("2026-06-02-0", "2026-06-01-0")):
        with pytest.raises(ValueError):
            hour_range(start, end)


PAGE = [
    raw(1, "PushEvent", sized('"ref":"refs/heads/main",', 176)),
    raw(2, "CreateEvent", sized('"ref":"dev", "note":"\U0001f600 \\u00e9",', 254)),
    raw(3, "DeleteEvent", sized('"ref":"v0.7.8","ref_type":"tag",', 84)),
    raw(4, "PullRequestEvent", sized("", 627)),
    raw(5, "WatchEvent", '{"action":"started"}'),
]


def test_page(spark, tmp_path):
    (tmp_path / "p.json").write_text("[" + ",\n  ".join(PAGE) + "]\n", encoding="utf-8")
    events, rejects = normalize_events(read_event_pages(spark, str(tmp_path)))
    rows = events.orderBy("event_id").collect()
    assert [(r.payload_size, r.ref) for r in rows] == [
        (176, "refs/heads/main"),
        (254, "dev"),
        (84, "v0.7.8"),
        (627, ""),
        (20, ""),
    ]
    assert rejects.count() == 0


def test_bad_elements_do_not_hurt_their_neighbours(spark, tmp_path):
    bad = ["5", "null", "[1]", raw(9, "WatchEvent", "{}", actor="5"), raw(9, "WatchEvent", "{}", id="5")]
    (tmp_path / "p.json").write_text("[" + ",".join([PAGE[0], *bad, PAGE[1]]) + "]", encoding="utf-8")
    (tmp_path / "q.json").write_text("[]")
    events, rejects = normalize_events(read_event_pages(spark, str(tmp_path)))
    assert sorted(r.payload_size for r in events.collect()) == [176, 254]
    assert rejects.count() == 5


@pytest.mark.parametrize("text", ['[{"id":"1"}', '{"id":"1"}', '[{"id":"1"},]', '[{"id":"1"}] x', '[{"id" "1"}]', ""])
def test_bad_page(spark, tmp_path, text):
    with pytest.raises(ValueError):
        split_page(text)
    (tmp_path / "p.json").write_text(text or " ")
    with pytest.raises(Exception):
        read_event_pages(spark, str(tmp_path)).collect()
    rejected = normalize_events(read_event_pages(spark, str(tmp_path), on_bad_page="reject"))[1]
    assert [r.reject_reason for r in rejected.collect()] == ["malformed_json"]


def test_split_page_keeps_source_text():
    elements = split_page(' [ {"payload" : { "a":  1 } ,"x":[{"payload":2}]} , {"payload":null}, {"payload":"null"}, {} ] ')
    assert [p for _, p in elements] == ['{ "a":  1 }', None, '"null"', None]
    assert json.loads(elements[0][0])["x"] == [{"payload": 2}]


def test_session_zone_does_not_matter(spark, archive):
    base = archive("2024-06-03-15", [line for line, *_ in GOLDEN])

    def times():
        events, _ = normalize_events(read_archive(spark, base, "2024-06-03-15"))
        return sorted(r.t for r in events.select(F.col("created_at").cast("string").alias("t")).collect())

    utc = times()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert times() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_deep_nesting_and_size_become_rejects(spark, tmp_path, monkeypatch):
    from tidemark.sources import pages

    (tmp_path / "deep").write_text('[{"payload":' + "[" * 50_000 + "]" * 50_000 + "}]")
    (tmp_path / "long").write_text("[" + " " * 3000 + "]")
    (tmp_path / "good").write_text("[]")
    monkeypatch.setattr(pages, "MAX_PAGE_BYTES", 200_000)
    rejected = normalize_events(read_event_pages(spark, str(tmp_path), on_bad_page="reject"))[1]
    assert rejected.count() == 1
    monkeypatch.setattr(pages, "MAX_PAGE_BYTES", 2000)
    rejected = normalize_events(read_event_pages(spark, str(tmp_path), on_bad_page="reject"))[1]
    texts = sorted(r.reject_text for r in rejected.collect())
    assert len(texts) == 2 and all(t.startswith("page exceeds 2000 bytes: file:") for t in texts)
    with pytest.raises(Exception, match="page exceeds"):
        read_event_pages(spark, str(tmp_path)).collect()


def test_pages_are_landed_as_one_file_each_and_nothing_else(spark, tmp_path):
    from tidemark.samples.landing import land_pages

    rows = [(k, "PushEvent", datetime(2024, 1, 1), 5, "user-5", 2, "org2/repo2", 0, "", 10, "") for k in range(250)]
    events = spark.createDataFrame(rows, CANONICAL).withColumn("event_id", F.when(F.col("event_id") != 7, F.col("event_id")))
    folder = land_pages(spark, events).removeprefix("file://")
    assert sorted(os.listdir(folder)) == ["page-0.txt", "page-1.txt", "page-2.txt", "page-None.txt"]
    found = normalize_events(read_event_pages(spark, folder))[0]
    assert sorted(r.event_id for r in found.collect()) == [k for k in range(250) if k != 7]


def test_a_page_builds_one_decoder(monkeypatch):
    built = []
    real = json.JSONDecoder
    monkeypatch.setattr(json, "JSONDecoder", lambda: built.append(1) or real())
    assert len(split_page("[" + ",".join(PAGE) + "]")) == len(PAGE)
    assert len(built) == 1
