"""The sample tables `events` and `part` seen as canonical events and a language lookup."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import second_of, to_rfc3339, ts_lit
from tidemark.functions.unsigned import to_text
from tidemark.operators.enrich import enrich_language
from tidemark.schema import CANONICAL_COLUMNS, CORRUPT, CREATE, FORK, ISSUES, PUSH, RAW, STAR
from tidemark.sources.bus import to_bus_messages

AS_OF = "2024-01-31 00:00:00"

TYPE_OF = {"click": STAR, "view": PUSH, "purchase": FORK, "signup": ISSUES, "error": CREATE}


def _choose(column: Column, choices: dict[str, str], default: str | None = None) -> Column:
    out = None
    for value, result in choices.items():
        out = F.when(column == value, result) if out is None else out.when(column == value, result)
    return out if default is None else out.otherwise(default)


def sample_events(
    spark: SparkSession,
    sf_dir: str,
    types: list[str] | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Canonical events without language. `types`, `start` and `end` only narrow the scan: they are
    predicates on the source columns, which the scan can use, unlike those on derived columns."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    if types is not None:
        source = source.filter(F.col("event_type").isin([s for s, t in TYPE_OF.items() if t in types]))
    if start is not None:
        source = source.filter(F.col("ts") >= ts_lit(start))
    if end is not None:
        source = source.filter(F.col("ts") < ts_lit(end))
    repo_id = F.col("repo_id")
    return (
        source.withColumn("repo_id", F.get_json_object("props", "$.k").cast("bigint") + 1)
        .select(
            "event_id",
            _choose(F.col("event_type"), TYPE_OF).alias("event_type"),
            second_of("ts").alias("created_at"),
            F.col("user_id").alias("actor_id"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_login"),
            "repo_id",
            F.concat(
                F.lit("org"), (repo_id % 10).cast("string"), F.lit("/repo"), repo_id.cast("string")
            ).alias("repo_name"),
            F.when(repo_id % 7 == 0, repo_id % 10 + 1).otherwise(0).cast("bigint").alias("org_id"),
            F.lit("").alias("language"),
            F.octet_length("props").cast("bigint").alias("payload_size"),
            _choose(F.col("event_type"), {"view": "refs/heads/main", "error": "main"}, "").alias("ref"),
        )
        .select(*CANONICAL_COLUMNS)
    )


def repo_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spark.read.parquet(f"{sf_dir}/part.parquet")
        .filter(F.col("p_size") <= 25)
        .select(F.col("p_partkey").alias("repo_id"), F.col("p_brand").alias("language"))
    )


def enriched_events(spark: SparkSession, sf_dir: str, **narrow) -> DataFrame:
    """With language; `p_partkey` is the key of `part`."""
    return enrich_language(sample_events(spark, sf_dir, **narrow), repo_languages(spark, sf_dir), unique=True)


# Raw feed form ------------------------------------------------------------------------------------

# Repositories whose events are damaged on purpose, one kind of damage each.
BAD_ID, NO_TYPE, NO_TIME, BROKEN, NUMBER_ID, NEGATIVE_ACTOR, NULL_ORG, NULL_PAYLOAD, NO_PAYLOAD = range(91, 100)


# A repository whose event ids lie in the upper half of the unsigned 64-bit numbers, and one whose actor ids do.
BIG_EVENTS, BIG_ACTORS = 85, 84
UPPER_HALF = -(1 << 63)


def with_big_ids(events: DataFrame) -> DataFrame:
    """The events of those repositories with 2^63 added to their ids."""
    return events.withColumns(
        {
            name: F.when(F.col("repo_id") == repo, F.col(name) + F.lit(UPPER_HALF)).otherwise(F.col(name))
            for name, repo in (("event_id", BIG_EVENTS), ("actor_id", BIG_ACTORS))
        }
    )


def raw_lines(events: DataFrame) -> DataFrame:
    """Every event as one line of raw feed JSON (`line`), some of them damaged, some with big ids."""
    repo, kind = F.col("repo_id"), F.col("event_type")
    events = with_big_ids(events.withColumn("_id", F.col("event_id")))
    eid, number = to_text("event_id"), F.col("_id").cast("string")
    push = F.when(
        repo % 2 == 0, F.lit('{"push_id":1,"size":1,"commits":[],"ref":"refs/heads/main"}')
    ).otherwise(F.lit('{"push_id":1,"ref":"refs/heads/main"}'))
    payload = (
        F.when(kind == PUSH, push)
        .when(kind == CREATE, F.lit('{"ref":"main","ref_type":"branch"}'))
        .when(kind == STAR, F.lit('{"action":"started"}'))
        .otherwise(F.concat(F.lit('{"ref":"ignored","n":'), number, F.lit("}")))
    )

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    def entity(*fields: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))

    actor_id = F.when(repo == NEGATIVE_ACTOR, F.lit("-5")).otherwise(to_text("actor_id"))
    org = F.when(repo == NULL_ORG, field("org", F.lit("null"))).when(
        F.col("org_id") > 0, field("org", entity(field("id", F.col("org_id").cast("string"))))
    )
    line = entity(
        field(
            "id",
            F.when(repo == BAD_ID, quoted(F.concat(F.lit("x"), eid))).when(repo == NUMBER_ID, eid).otherwise(quoted(eid)),
        ),
        field("type", quoted(F.when(repo == NO_TYPE, "").otherwise(kind))),
        F.when(repo != NO_TIME, field("created_at", quoted(to_rfc3339("created_at")))),
        field("actor", entity(field("id", actor_id), field("login", quoted(F.col("actor_login"))))),
        field("repo", entity(field("id", repo.cast("string")), field("name", quoted(F.col("repo_name"))))),
        org,
        F.when(repo == NULL_PAYLOAD, field("payload", F.lit("null"))).when(
            repo != NO_PAYLOAD, field("payload", payload)
        ),
    )
    return events.select("*", F.when(repo == BROKEN, F.substring(line, 1, 30)).otherwise(line).alias("line"))


# Repositories whose archive lines are odd: one JSON object with spread payload or with a payload that is a text, an array, text
# after the object, blank lines before the event.
SPREAD, TEXT_PAYLOAD, IN_ARRAY, WITH_TAIL, AFTER_BLANKS = range(86, 91)
SPREAD_PAYLOAD, TEXT = '{ "ref" : [ 1.50 ] }', '"\\u0041 \\/ \u00e9"'


def archive_lines(events: DataFrame) -> DataFrame:
    """`raw_lines` as an archive may hold them; a row can be several lines, also empty ones and lines of blanks."""
    repo, line = F.col("repo_id"), F.col("line")
    head = F.regexp_extract("line", r"^(.*)\"payload\":", 1)
    odd = (
        F.when(repo == SPREAD, F.concat(head, F.lit(f'"payload"\t: {SPREAD_PAYLOAD} }}')))
        .when(repo == TEXT_PAYLOAD, F.concat(head, F.lit(f'"payload":{TEXT}}}')))
        .when(repo == IN_ARRAY, F.concat(F.lit("["), line, F.lit("]")))
        .when(repo == WITH_TAIL, F.concat(line, F.lit(" {}")))
        .when(repo == AFTER_BLANKS, F.concat(F.lit("\n\r\n \t\n  "), line, F.lit(" \r")))
        .otherwise(line)
    )
    return raw_lines(events).withColumn("line", odd)


def raw_events(events: DataFrame) -> DataFrame:
    """The same lines parsed into raw events (they are compact ASCII, so payload sizes stay exact)."""
    parsed = F.from_json("line", RAW, {"columnNameOfCorruptRecord": CORRUPT})
    return raw_lines(events).select(parsed.alias("r")).select("r.*")


# Bus form -----------------------------------------------------------------------------------------


def bus_messages(events: DataFrame) -> DataFrame:
    """Messages of six source partitions, offsets rising with the event id; five kinds of poison."""
    typed = events.withColumn("event_type", F.when(F.col("repo_id") == 93, "").otherwise(F.col("event_type")))
    good = to_bus_messages(with_big_ids(typed))
    eid = (F.col("key").cast("decimal(20,0)") % F.lit(1 << 62).cast("decimal(20,0)")).cast("bigint")
    repo = F.get_json_object("value", "$.repo_id").cast("int")
    value = (
        F.when(repo == 91, F.lit("not json"))
        .when(repo == 92, F.lit("{}"))
        .when(repo == 94, F.regexp_replace("value", r'"created_at":"[^"]*"', '"created_at":"0001-01-01T00:00:00Z"'))
        .when(repo == 95, F.regexp_replace("value", r'"ref":"[^"]*"', '"ref":7'))
        .when(repo == 96, F.concat("value", F.lit(" tail")))
        .otherwise(F.col("value"))
    )
    return good.select(
        "key",
        value.alias("value"),
        F.lit("events").alias("topic"),
        (eid % 6).cast("int").alias("partition"),
        F.floor(eid / 6).cast("bigint").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )
