"""Raw feed events to canonical events, with a reason for every event that cannot be used."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.timestamps import parse_rfc3339
from tidemark.functions.unsigned import of_digits, of_number
from tidemark.functions.variants import compute_once, is_missing, is_string, string_value
from tidemark.schema import CANONICAL_COLUMNS, CORRUPT, REF_TYPES

MALFORMED = "malformed_json"
WRONG_TYPE = "wrong_field_type"
NO_TYPE = "no_type"
NO_CREATED_AT = "no_created_at"
BAD_ID = "bad_id"
REJECT_REASONS = [MALFORMED, WRONG_TYPE, NO_TYPE, NO_CREATED_AT, BAD_ID]

_ENTITIES = ["actor", "repo", "org"]

# The feed's zero time stands for "not set".
_ZERO_TIME = "TIMESTAMP_NTZ '0001-01-01 00:00:00'"


def payload_size(payload: Column) -> Column:
    """Bytes of the payload as it stood in the source; absent and `null` count as 0."""
    return F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint")


def payload_ref(event_type: Column, payload: Column) -> Column:
    """`ref` of the payload for the types that carry one; anything but a string gives ''."""
    ref = F.from_json(payload, "ref VARIANT")["ref"]
    return F.when(event_type.isin(REF_TYPES), F.coalesce(string_value(ref), F.lit(""))).otherwise("")


def payload_epoch(raw: DataFrame) -> Column:
    """'old' if the push payload still carries its commit fields, 'new' if not, '' for other types."""
    # --- fixed values of the event feed ---
    commit_fields = ["commits", "size", "distinct_size"]
    # --- end of fixed values ---
    parsed = F.from_json(raw["payload"], ", ".join(f"{f} VARIANT" for f in commit_fields))
    has_any = F.coalesce(*[F.when(parsed[f].isNotNull(), True) for f in commit_fields], F.lit(False))
    return F.when(string_value(raw["type"]) == "PushEvent", F.when(has_any, "old").otherwise("new")).otherwise("")


def tag_events(raw: DataFrame, *more: str) -> DataFrame:
    """All canonical columns plus `reject_reason` (NULL = usable) and the columns `more`: both outcomes in one pass.

    Wrong types of whole embedded objects are noticed by the JSON reader, which then fills the corrupt column; wrong
    types of texts and ids are noticed here. Missing objects and members are allowed, ids are unsigned 64-bit numbers.
    """
    texts = {
        "id": raw["id"],
        "type": raw["type"],
        "created": raw["created_at"],
        "login": raw["actor"]["login"],
        "name": raw["repo"]["name"],
    }
    typed = compute_once(
        raw,
        **{f"_{name}": string_value(value) for name, value in texts.items()},
        _texts_ok=reduce(and_, [is_missing(value) | is_string(value) for value in texts.values()]),
        **{f"_{entity}_id": of_number(raw[entity]["id"]) for entity in _ENTITIES},
    )
    typed = compute_once(typed, _time=parse_rfc3339(F.col("_created")), _number=of_digits(F.col("_id")))
    ids_ok = reduce(and_, [is_missing(raw[entity]["id"]) | F.col(f"_{entity}_id").isNotNull() for entity in _ENTITIES])

    def number(entity: str) -> Column:
        return F.coalesce(F.col(f"_{entity}_id"), F.lit(0).cast("bigint"))

    # A field of the wrong type leaves its neighbours readable, broken JSON leaves nothing.
    nothing_read = reduce(and_, [raw[c].isNull() for c in ("id", "type", "created_at", "actor", "repo", "org", "payload")])
    reason = (
        F.when(raw[CORRUPT].isNotNull() & nothing_read, MALFORMED)
        .when(
            raw[CORRUPT].isNotNull()
            | ~F.col("_texts_ok")
            | (F.col("_created").isNotNull() & F.col("_time").isNull())
            | ~ids_ok,
            WRONG_TYPE,
        )
        .when(F.coalesce("_type", F.lit("")) == "", NO_TYPE)
        .when(F.coalesce(F.col("_time") == F.expr(_ZERO_TIME), F.lit(True)), NO_CREATED_AT)
        .when(F.col("_number").isNull(), BAD_ID)
    )
    return typed.select(
        F.col("_number").alias("event_id"),
        F.col("_type").alias("event_type"),
        F.col("_time").alias("created_at"),
        number("actor").alias("actor_id"),
        F.coalesce("_login", F.lit("")).alias("actor_login"),
        number("repo").alias("repo_id"),
        F.coalesce("_name", F.lit("")).alias("repo_name"),
        number("org").alias("org_id"),
        F.lit("").alias("language"),
        payload_size(raw["payload"]).alias("payload_size"),
        payload_ref(F.col("_type"), raw["payload"]).alias("ref"),
        reason.alias("reject_reason"),
        raw[CORRUPT].alias("reject_text"),
        *more,
    )


def normalize_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical events, rejects). Each side is a filter over the same tagged rows."""
    tagged = tag_events(raw)
    return usable(tagged), tagged.filter(F.col("reject_reason").isNotNull())


def usable(tagged: DataFrame, *more: str) -> DataFrame:
    return tagged.filter(F.col("reject_reason").isNull()).select(*CANONICAL_COLUMNS, *more)


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.filter(F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count("*").alias("rejected"))


def observe_rejects(tagged: DataFrame, observation: Observation) -> DataFrame:
    """Count rejects per reason while another action runs, without a second pass over the source."""
    return tagged.observe(
        observation,
        F.count("*").alias("seen"),
        *[F.count_if(F.col("reject_reason") == r).alias(r) for r in REJECT_REASONS],
    )
