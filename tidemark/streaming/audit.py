"""What each batch did, and what follows from it: lag and health."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import month_number, seconds_of, utc_now
from tidemark.schema import AUDIT
from tidemark.sources.store import MONTH, read_table, write_table

_COLUMNS = [part.strip().split(" ")[0] for part in AUDIT.split(",")]


def batch_audit(checked: DataFrame, batch_id: int, latency_seconds: float, end_offsets: dict[int, int]) -> DataFrame:
    """One row per source partition of a checked batch. `position` is the next offset to read.

    `end_offsets` has one entry per source partition; a partition missing there has an unknown end.
    """
    ends = F.lit(None).cast("bigint")
    if end_offsets:
        entries = [F.lit(v) for p, e in end_offsets.items() for v in (int(p), int(e))]
        ends = F.try_element_at(F.create_map(*entries), F.col("partition")).cast("bigint")
    return (
        checked.groupBy("partition")
        .agg(
            F.count("*").alias("consumed"),
            F.count_if(F.col("error").isNull()).alias("inserted"),
            F.count_if(F.col("error").isNotNull()).alias("dead_lettered"),
            (F.max("offset") + 1).alias("position"),
        )
        .select(
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            utc_now().alias("ts"),
            "partition",
            "consumed",
            "inserted",
            "dead_lettered",
            "position",
            ends.alias("end_offset"),
            F.lit(latency_seconds).cast("double").alias("latency_seconds"),
        )
    )


def write_audit(rows: DataFrame, path: str, load: str) -> None:
    """At most one row per source partition, in the month of the batch."""
    write_table(rows.withColumn(MONTH, month_number("ts")), path, load, [], ["batch_id", "partition"])


def read_audit(spark: SparkSession, path: str, months: list[int] | None = None) -> DataFrame:
    return read_table(spark, path, AUDIT, months).select(*_COLUMNS)


def lag_by_partition(audit: DataFrame) -> DataFrame:
    """Messages not yet read, per source partition and in total (partition NULL).

    The newest batch with a known end counts; partitions whose end was never known are left out.
    """
    lag = (
        audit.filter(F.col("end_offset").isNotNull())
        .groupBy("partition")
        .agg(F.max_by(F.col("end_offset") - F.col("position"), "batch_id").alias("lag"))
    )
    return lag.rollup("partition").agg(F.sum("lag").alias("lag"))


# Upper bounds of the batch-size histogram.
BATCH_SIZE_BOUNDS = [1, 10, 100, 1_000, 5_000, 10_000, 20_000, 50_000]


def ingest_health(audit: DataFrame, every: str = "1 minute") -> DataFrame:
    """Per interval: batches, rates per second, dead-letter share in percent, slowest write."""
    span = F.window("ts", every)
    seconds = seconds_of("span.end") - seconds_of("span.start")
    return (
        audit.groupBy(span.alias("span"))
        .agg(
            F.count_distinct("batch_id").alias("batches"),
            F.sum("consumed").alias("consumed"),
            F.sum("inserted").alias("inserted"),
            F.sum("dead_lettered").alias("dead_lettered"),
            F.max("latency_seconds").alias("slowest_seconds"),
        )
        .select(
            F.col("span.start").alias("interval_start"),
            "batches",
            "consumed",
            "inserted",
            "dead_lettered",
            (F.col("consumed") / seconds).alias("consumed_per_second"),
            (F.col("inserted") / seconds).alias("inserted_per_second"),
            F.when(F.col("consumed") > 0, 100 * F.col("dead_lettered") / F.col("consumed"))
            .otherwise(0.0)
            .alias("dead_letter_percent"),
            "slowest_seconds",
        )
    )


def batch_sizes(audit: DataFrame) -> DataFrame:
    """Cumulative histogram of valid events per batch: batches with at most `up_to` events."""
    sizes = audit.groupBy("batch_id").agg(F.sum("inserted").alias("size"))
    counts = sizes.agg(
        *[F.count_if(F.col("size") <= b).alias(str(b)) for b in BATCH_SIZE_BOUNDS], F.count("*").alias("all")
    )
    pairs = [F.struct(F.lit(b).alias("up_to"), F.col(str(b)).alias("batches")) for b in BATCH_SIZE_BOUNDS]
    pairs.append(F.struct(F.lit(None).cast("int").alias("up_to"), F.col("all").alias("batches")))
    return counts.select(F.inline(F.array(*pairs)))


def end_offsets_of(progress: dict) -> dict[int, int]:
    """Newest offset per partition from a Kafka source's progress report (`StreamingQuery.lastProgress`).

    Sources without partitions (files) report something else and give no ends.
    """
    ends: dict[int, int] = {}
    for source in progress.get("sources", []):
        latest = source.get("latestOffset")
        if isinstance(latest, str):
            try:
                latest = json.loads(latest)
            except ValueError:
                continue
        for partitions in (latest if isinstance(latest, dict) else {}).values():
            if isinstance(partitions, dict):
                ends.update({int(p): int(o) for p, o in partitions.items()})
    return ends
