"""Every table shape of the engine, declared once.

All event times are TIMESTAMP_NTZ holding UTC wall clock, cut to whole seconds. Results therefore do
not depend on the session time zone, and `created_at >= literal` is a plain Parquet predicate.
"""

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# Raw feed event. Texts are VARIANT, because a STRING column would silently accept a number there, and so are ids, because a
# BIGINT column would refuse the upper half of the unsigned numbers. `payload` stays STRING: the archive and page readers
# copy its exact source bytes. Only the listed members of the embedded objects are built, the reader skips the rest.
RAW = T.StructType(
    [
        T.StructField("id", T.VariantType()),
        T.StructField("type", T.VariantType()),
        T.StructField("created_at", T.VariantType()),
        T.StructField(
            "actor", T.StructType([T.StructField("id", T.VariantType()), T.StructField("login", T.VariantType())])
        ),
        T.StructField(
            "repo", T.StructType([T.StructField("id", T.VariantType()), T.StructField("name", T.VariantType())])
        ),
        T.StructField("org", T.StructType([T.StructField("id", T.VariantType())])),
        T.StructField("payload", T.StringType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

# The four ids are unsigned 64-bit numbers, held as their bits (see `functions.unsigned`).
CANONICAL = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("actor_id", T.LongType(), False),
        T.StructField("actor_login", T.StringType(), False),
        T.StructField("repo_id", T.LongType(), False),
        T.StructField("repo_name", T.StringType(), False),
        T.StructField("org_id", T.LongType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("payload_size", T.LongType(), False),
        T.StructField("ref", T.StringType(), False),
    ]
)
CANONICAL_COLUMNS = CANONICAL.fieldNames()
ID_COLUMNS = ["event_id", "actor_id", "repo_id", "org_id"]

# What a message source delivers, whatever the transport.
MESSAGE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

DEAD_LETTER_COLUMNS = ["key", "value", "error", "error_type", "source_partition", "source_offset"]

# Roll-ups. `last_event_id` says which event the name was taken from, so that partial rows of one key
# can still be merged to the newest name.
REPO_STARS_HOURLY = "repo_stars_hourly"
LANGUAGE_DAILY = "language_daily"
ACTIVITY = "activity_weekday_hour"

ROLLUP_SCHEMAS = {
    REPO_STARS_HOURLY: "repo_id BIGINT, repo_name STRING, hour TIMESTAMP_NTZ, stars BIGINT, last_event_id BIGINT",
    LANGUAGE_DAILY: "day DATE, language STRING, events BIGINT",
    ACTIVITY: "weekday INT, hour INT, events BIGINT",
}

AUDIT = (
    "batch_id BIGINT, ts TIMESTAMP_NTZ, partition INT, consumed BIGINT, inserted BIGINT, "
    "dead_lettered BIGINT, position BIGINT, end_offset BIGINT, latency_seconds DOUBLE"
)

# --- fixed values of the event feed ---
STAR = "WatchEvent"
PUSH = "PushEvent"
FORK = "ForkEvent"
ISSUES = "IssuesEvent"
CREATE = "CreateEvent"
DELETE = "DeleteEvent"
REF_TYPES = [PUSH, CREATE, DELETE]
# --- end of fixed values ---
