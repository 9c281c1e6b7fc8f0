"""The message bus: a Kafka topic, or files with the same columns where no broker is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import to_rfc3339
from tidemark.functions.unsigned import to_decimal, to_text
from tidemark.schema import CANONICAL_COLUMNS, ID_COLUMNS, MESSAGE

# --- fixed values of the dead-letter format ---
HEADER_ERROR = "x-error"
HEADER_ERROR_TYPE = "x-error-type"
HEADER_SOURCE_PARTITION = "x-source-partition"
HEADER_SOURCE_OFFSET = "x-source-offset"
# --- end of fixed values ---


def to_bus_messages(events: DataFrame) -> DataFrame:
    """key = decimal event id, value = canonical JSON in column order. The broker sets the timestamp."""
    written = {"created_at": to_rfc3339("created_at")} | {c: to_decimal(c) for c in ID_COLUMNS}
    fields = [written.get(c, F.col(c)).alias(c) for c in CANONICAL_COLUMNS]
    return events.select(
        to_text("event_id").alias("key"),
        F.to_json(F.struct(*fields)).alias("value"),
    )


def kafka_options(servers: str, topic: str, max_offsets: int | None = None) -> dict[str, str]:
    """First start reads from the beginning; an offset the broker no longer has is an error.

    Without `max_offsets` a batch takes what is there, so a backlog drains at the speed of the cluster.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        "includeHeaders": "true",
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_event_stream(
    spark: SparkSession, *, kafka: dict[str, str] | None = None, files: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Streaming messages with the columns of `MESSAGE`. Give `kafka` options or a folder of Parquet files."""
    if (kafka is None) == (files is None):
        raise ValueError("give either kafka options or a folder")
    if files is not None:
        reader = spark.readStream.schema(MESSAGE)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(files)
    stream = spark.readStream.format("kafka").options(**kafka).load()
    return stream.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp"
    )


def write_messages(messages: DataFrame, servers: str, topic: str) -> None:
    """Send messages, with their headers if they have any (dead letters do)."""
    columns = [c for c in ("key", "value", "headers") if c in messages.columns]
    messages.select(*columns).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def dead_letter_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as bus messages: original key and value, the reason in headers."""

    def header(name: str, column: str):
        return F.struct(F.lit(name).alias("key"), F.encode(F.col(column).cast("string"), "UTF-8").alias("value"))

    return letters.select(
        "key",
        "value",
        F.array(
            header(HEADER_ERROR, "error"),
            header(HEADER_ERROR_TYPE, "error_type"),
            header(HEADER_SOURCE_PARTITION, "source_partition"),
            header(HEADER_SOURCE_OFFSET, "source_offset"),
        ).alias("headers"),
    )
