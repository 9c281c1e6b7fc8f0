"""What the engine itself reports of a stream: rows, durations and offsets of each batch, kept as a table."""

from __future__ import annotations

import json
import threading
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.timestamps import month_number
from tidemark.sources.store import MONTH, batch_load, fold_loads, read_table, write_table
from tidemark.streaming.ingest import Sinks

# One row per batch and source partition; sources without partitions have one row with partition NULL.
PROGRESS = (
    "stream STRING, batch_id BIGINT, ts TIMESTAMP_NTZ, input_rows BIGINT, trigger_ms BIGINT, add_batch_ms BIGINT, "
    "partition INT, start_offset BIGINT, end_offset BIGINT, latest_offset BIGINT"
)
_ORDER = ["batch_id", "partition"]


def _offsets(text: str | None) -> dict[int, int]:
    """Offset per partition of a Kafka source's report; other sources have none."""
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return {}
    topics = found.values() if isinstance(found, dict) else []
    return {int(p): int(o) for partitions in topics if isinstance(partitions, dict) for p, o in partitions.items()}


def progress_rows(progress: dict) -> list[tuple]:
    """Rows of one progress report (`StreamingQueryProgress.json`, parsed)."""
    durations = progress.get("durationMs") or {}
    moment = datetime.fromisoformat(progress["timestamp"]).astimezone(UTC).replace(tzinfo=None, microsecond=0)
    head = (
        progress["id"].replace("-", "")[:12],
        progress["batchId"],
        moment,
        progress.get("numInputRows", 0),
        durations.get("triggerExecution"),
        durations.get("addBatch"),
    )
    rows = []
    for source in progress.get("sources") or []:
        first, end, latest = (_offsets(_text(source.get(f"{name}Offset"))) for name in ("start", "end", "latest"))
        rows += [(*head, p, first.get(p), end[p], latest.get(p)) for p in sorted(end)]
    return rows or [(*head, None, None, None, None)]


def _text(offset) -> str | None:
    return offset if offset is None or isinstance(offset, str) else json.dumps(offset)


class ProgressLog(StreamingQueryListener):
    """Keeps the reports of the streams that `start_ingest` runs for some sinks in the table `<root>/progress`.

    Add it with `spark.streams.addListener`. Reports are held until `every` batches have come or the stream ends and are then
    written as one load named after its batches; a crash loses those not yet written, and nothing of the data depends
    on them. Idle triggers, which have no batch of their own, are left out.
    """

    def __init__(self, spark: SparkSession, sinks: Sinks, every: int = 100):
        self.spark, self.sinks, self.every = spark, sinks, every
        self._held: dict[tuple[str, int], list[tuple]] = {}
        self._runs: set[str] = set()
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.sinks.name:
            self._runs.add(str(event.runId))
            self._ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        if progress.get("name") == self.sinks.name and "addBatch" in (progress.get("durationMs") or {}):
            rows = progress_rows(progress)
            self._held[rows[0][:2]] = rows
            if len(self._held) >= self.every:
                self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._runs:
            self._runs.discard(str(event.runId))
            try:
                self.flush()
            finally:
                self._ended.set()

    def wait(self, seconds: float = 60) -> None:
        """Until the stream has ended and its last reports are written; they come a little after the stream itself ends."""
        if not self._ended.wait(seconds):
            raise TimeoutError("the stream has not reported its end")

    def flush(self) -> None:
        held, self._held = self._held, {}
        for stream in sorted({s for s, _ in held}):
            batches = sorted(b for s, b in held if s == stream)
            rows = self.spark.createDataFrame([r for b in batches for r in held[stream, b]], PROGRESS)
            name = f"{self.sinks.name}-{stream}"
            load = f"{batch_load(name, batches[0])}~{batch_load(name, batches[-1])}"
            write_table(rows.withColumn(MONTH, month_number("ts")), progress_path(self.sinks), load, [], _ORDER)


def progress_path(sinks: Sinks) -> str:
    return f"{sinks.root}/progress"


def read_progress(spark: SparkSession, sinks: Sinks, months: list[int] | None = None) -> DataFrame:
    columns = [part.strip().split(" ")[0] for part in PROGRESS.split(",")]
    return read_table(spark, progress_path(sinks), PROGRESS, months).select(*columns)


def fold_progress(spark: SparkSession, sinks: Sinks, below: int) -> None:
    """Merge the reports of the stream `sinks.stream` on batches under `below` into one load per month."""
    first, last = batch_load(sinks.writer, 0), batch_load(sinks.writer, below - 1)
    fold_loads(spark, progress_path(sinks), PROGRESS, first, last, _ORDER, [])


def lag_by_progress(progress: DataFrame) -> DataFrame:
    """Messages not yet read at the newest report, per stream and source partition, and per stream in total (partition NULL)."""
    lag = (
        progress.filter(F.col("latest_offset").isNotNull())
        .groupBy("stream", "partition")
        .agg(F.max_by(F.col("latest_offset") - F.col("end_offset"), "batch_id").alias("lag"))
    )
    total = lag.groupBy("stream").agg(F.sum("lag").alias("lag")).select("stream", F.lit(None).cast("int").alias("partition"), "lag")
    return lag.unionByName(total)


def batch_durations(progress: DataFrame, every: str = "1 minute") -> DataFrame:
    """Per stream and interval: batches, rows, rows per busy second, mean and slowest trigger in milliseconds."""
    batches = progress.dropDuplicates(["stream", "batch_id"])
    span = F.window("ts", every)
    return (
        batches.groupBy("stream", span.alias("span"))
        .agg(
            F.count("*").alias("batches"),
            F.sum("input_rows").alias("input_rows"),
            F.try_divide(1000 * F.sum("input_rows"), F.sum("trigger_ms")).alias("rows_per_busy_second"),
            F.avg("trigger_ms").alias("mean_trigger_ms"),
            F.max("trigger_ms").alias("slowest_trigger_ms"),
        )
        .select("stream", F.col("span.start").alias("interval_start"), "batches", "input_rows", "rows_per_busy_second", "mean_trigger_ms", "slowest_trigger_ms")
    )
