"""Continuous ingest: messages to events, dead letters, roll-ups and an audit row, batch by batch."""

from __future__ import annotations

import logging
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.enrich import dedup_events, unseen_events
from tidemark.operators.names import fold_names, write_names
from tidemark.operators.normalize import observe_rejects, tag_events, usable
from tidemark.operators.reconcile import fold_fingerprints, write_fingerprints
from tidemark.operators.rollups import fold_rollup, fold_rollup_loads, write_rollups
from tidemark.operators.sketches import SKETCH_SCHEMAS, fold_sketches, write_sketches
from tidemark.operators.validate import check_messages, poison_messages, valid_events
from tidemark.schema import AUDIT, CANONICAL_COLUMNS, ROLLUP_SCHEMAS
from tidemark.session import run_together
from tidemark.sources.archive import hour_range, parse_hour, read_archive
from tidemark.sources.store import (
    DEAD_LETTERS,
    EVENT_BLOOM,
    EVENT_ORDER,
    EVENTS_DDL,
    LOAD,
    batch_load,
    exists,
    fold_batches,
    fold_events,
    fold_loads,
    has_loads,
    read_table,
    month_loads,
    stored_months,
    write_dead_letters,
    write_events,
)
from tidemark.streaming.audit import batch_audit, end_offsets_of, write_audit

DEFAULT_TRIGGER = "2 seconds"

# A failed write is tried again with the same batch, waiting 1, 2, 4, ... up to 30 seconds.
# --- fixed values of the ingest contract ---
FIRST_WAIT_SECONDS = 1.0
LONGEST_WAIT_SECONDS = 30.0
# --- end of fixed values ---
DEFAULT_RETRIES = 10

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Sinks:
    """Folders of one ingest on shared storage."""

    root: str
    name: str = "ingest"
    stream: str = ""  # identity of the stream that writes; `start_ingest` fills in that of the checkpoint

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def rollups(self) -> str:
        return f"{self.root}/rollups"

    @property
    def names(self) -> str:
        return f"{self.root}/names"

    @property
    def fingerprints(self) -> str:
        return f"{self.root}/fingerprints"

    @property
    def sketches(self) -> str:
        return f"{self.root}/sketches"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit"

    @property
    def writer(self) -> str:
        return f"{self.name}-{self.stream}" if self.stream else self.name

    def load(self, batch_id: int) -> str:
        return batch_load(self.writer, batch_id)


def maintain_rollups(events: DataFrame, sinks: Sinks, batch_id: int) -> None:
    """Add one batch to the roll-ups; a repeated batch replaces what it had added before."""
    write_rollups(events, sinks.rollups, sinks.load(batch_id))


def _with_retries(step: Callable[[], None], retries: int) -> None:
    """The source stands still meanwhile, so no more than this one batch is ever held."""
    wait = FIRST_WAIT_SECONDS
    for left in range(retries, -1, -1):
        try:
            return step()
        except (OSError, PySparkException) as error:
            if left == 0 or not _may_pass(error):
                raise
            logger.exception("batch write failed, next try in %s s", wait)
            time.sleep(wait)
            wait = min(2 * wait, LONGEST_WAIT_SECONDS)


# What shows up in the message of a failure of storage or executors, as opposed to one of the program.
_PASSING = re.compile(r"IOException|Connection|[Tt]imeout|[Tt]imed out|ExecutorLost|FetchFailed|No space left|FileSystem|Throttl")


def _may_pass(error: Exception) -> bool:
    return isinstance(error, OSError) or bool(_PASSING.search(str(error)))


def write_batch(
    messages: DataFrame,
    batch_id: int,
    sinks: Sinks,
    end_offsets: Callable[[], dict[int, int]] | None = None,
    rollups: bool = True,
    retries: int = 0,
    sketches: bool = False,
    fingerprints: bool = False,
    only_unseen: bool = False,
    names: bool = False,
) -> None:
    """Store one micro-batch in every sink.

    Each sink is overwritten under the name of this batch. If a write fails it is repeated with the same
    rows; if the job dies anywhere in between, Spark runs the same batch again. Either way every sink
    ends up as if there had been one run, and only then is the batch committed. The checked batch is
    cached because six writes read it; a lost executor's part of the cache is recomputed from the source.
    """
    checked = check_messages(messages)
    for original in ("key", "value"):  # needed again only for dead letters
        checked = checked.withColumn(original, F.when(F.col("error").isNotNull(), F.col(original)))
    checked = checked.persist()
    load = sinks.load(batch_id)

    def fresh() -> DataFrame:
        events = valid_events(checked)
        return unseen_events(dedup_events(events), sinks.events, load) if only_unseen else events

    def store_events() -> None:
        started = time.perf_counter()
        write_events(fresh(), sinks.events, load)
        latency = time.perf_counter() - started
        write_audit(batch_audit(checked, batch_id, latency, end_offsets() if end_offsets else {}), sinks.audit, load)

    def store() -> None:
        write_dead_letters(poison_messages(checked), sinks.dead_letters, load)  # fills the cache
        steps = [store_events]
        if rollups:
            steps.append(lambda: maintain_rollups(fresh(), sinks, batch_id))
        if sketches:
            steps.append(lambda: write_sketches(fresh(), sinks.sketches, load))
        if fingerprints:
            steps.append(lambda: write_fingerprints(fresh(), sinks.fingerprints, load))
        if names:
            steps.append(lambda: write_names(fresh(), sinks.names, load))
        run_together(messages.sparkSession, *steps)

    try:
        _with_retries(store, retries)
    finally:
        checked.unpersist()


def start_ingest(
    messages: DataFrame,
    sinks: Sinks,
    checkpoint: str,
    trigger: dict | None = None,
    end_offsets: Callable[[], dict[int, int]] | None = None,
    rollups: bool = True,
    retries: int = DEFAULT_RETRIES,
    beside: bool = False,
    sketches: bool = False,
    fingerprints: bool = False,
    only_unseen: bool = False,
    names: bool = False,
) -> StreamingQuery:
    """One query for the whole write path. Batch size is bounded by the source (`maxOffsetsPerTrigger`)
    and by the trigger, whichever comes first; the offset is committed after all writes succeeded.

    Loads carry the identity that the checkpoint gives the stream, so two streams never replace each other's
    batches. A new checkpoint on sinks that other streams have filled would read its source from the start
    once more; that is refused unless `beside` says that the source is another one.

    `sketches` also maintains the daily sketches (`operators.sketches`), of which the corpus figures can then be read, `fingerprints`
    the sums by which roll-ups are reconciled month by month (`operators.reconcile`).
    `only_unseen` stores of each batch the events that no other load has, one of each id (`operators.enrich.unseen_events`): for sources
    that overlap. `names` keeps the history of repository names (`operators.names`). The audit still counts all valid messages.
    Without `end_offsets` the audit takes the newest offsets from the query's own progress: those of the
    batch before, as the source reported them.
    """
    spark = messages.sparkSession
    if not beside and not exists(spark, f"{checkpoint}/metadata") and exists(spark, sinks.events):
        if has_loads(spark, sinks.events, f"{sinks.name}-", f"{sinks.name}."):
            raise ValueError("these sinks hold batches of another checkpoint; pass beside=True for another source")
    running: list[StreamingQuery] = []
    started = threading.Event()

    def ends() -> dict[int, int]:
        return end_offsets_of(running[0].lastProgress or {})

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        own = replace(sinks, stream=stream_identity(running[0]))
        write_batch(batch, batch_id, own, end_offsets or ends, rollups, retries, sketches, fingerprints, only_unseen, names)

    running.append(
        messages.writeStream.queryName(sinks.name)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": DEFAULT_TRIGGER}))
        .foreachBatch(write)
        .start()
    )
    started.set()
    return running[0]


def stream_identity(query: StreamingQuery) -> str:
    """The identity kept in the checkpoint, as it stands in the names of loads."""
    return query.id.replace("-", "")[:12]


def fold_finished(spark: SparkSession, sinks: Sinks, below: int) -> None:
    """Fold the batches of the stream `sinks.stream` under the last committed batch id, in every table."""
    fold_events(spark, sinks.events, sinks.writer, below)
    for name in ROLLUP_SCHEMAS:
        fold_rollup(spark, sinks.rollups, name, sinks.writer, below)
    for name in SKETCH_SCHEMAS:
        fold_sketches(spark, sinks.sketches, name, sinks.writer, below)
    fold_fingerprints(spark, sinks.fingerprints, sinks.writer, below)
    fold_names(spark, sinks.names, sinks.writer, below)
    fold_batches(spark, sinks.dead_letters, DEAD_LETTERS, sinks.writer, below, ["source_partition", "source_offset"], ["source_partition"])
    fold_batches(spark, sinks.audit, AUDIT, sinks.writer, below, ["batch_id", "partition"], ["partition"])


def dedup_stream(events: DataFrame, horizon: str) -> DataFrame:
    """Drop event ids already seen within `horizon` of arrival; seeing an id again does not prolong it.

    The watermark runs on arrival time, which never goes backwards, so no event is ever late and none is
    lost: an old `created_at` or ids out of order do not matter.
    """
    return (
        events.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", horizon)
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("_arrived")
    )


def ingest_archive(
    spark: SparkSession, base: str, start: str, end: str | None, sinks: Sinks, sketches: bool = False
) -> dict[str, int]:
    """Load archive hours into the event table and its roll-ups; returns seen and rejected line counts.

    The source is parsed once: the reject counters ride along with the write, and the roll-ups are built
    from the stored loads, not from the dumps. Every hour is a load of its own, so a range that overlaps an
    earlier one replaces the hours they share; folded hours can only be replaced by all hours of their fold.
    """
    hours = hour_range(start, end) if end is not None else [parse_hour(start)]
    loads = hour_load(hours[0]), hour_load(hours[-1])
    _check_folds(spark, sinks.events, *loads)
    counters = Observation("rejects")
    raw = read_archive(spark, base, start, end, file_column=LOAD)
    file_hour = F.regexp_extract(LOAD, r"(\d{4}-\d{2}-\d{2})-(\d+)\.json", 2)
    day = F.regexp_extract(LOAD, r"(\d{4}-\d{2}-\d{2})-(\d+)\.json", 1)
    tagged = observe_rejects(tag_events(raw, LOAD), counters)
    named = usable(tagged, LOAD).withColumn(LOAD, F.concat(F.lit("archive-"), day, F.lit("-"), F.lpad(file_hour, 2, "0")))
    write_events(named, sinks.events, loads)
    stored = read_table(spark, sinks.events, EVENTS_DDL).filter(F.col(LOAD).between(*loads))
    write_rollups(stored.select(*CANONICAL_COLUMNS, LOAD), sinks.rollups, loads)
    if sketches:
        write_sketches(stored.select(*CANONICAL_COLUMNS, LOAD), sinks.sketches, loads)
    return counters.get


def fold_archive(spark: SparkSession, sinks: Sinks, start: str, end: str) -> None:
    """Fold the loaded hours [start, end) into one load per month, events and roll-ups.

    For hours that are settled: a folded hour can only be loaded again together with all hours of its fold. Not to be run while
    these hours are being loaded. A call after a crash goes on where the last one stopped.
    """
    hours = hour_range(start, end)
    first, last = hour_load(hours[0]), hour_load(hours[-1])
    fold_loads(spark, sinks.events, EVENTS_DDL, first, last, EVENT_ORDER, ["event_type"], EVENT_BLOOM)
    for name in ROLLUP_SCHEMAS:
        fold_rollup_loads(spark, sinks.rollups, name, first, last)


def _check_folds(spark: SparkSession, path: str, first: str, last: str) -> None:
    """Refuse to load some hours of a fold again: their old rows cannot be told from the others'."""
    for month in stored_months(spark, path):
        for name in month_loads(spark, path, month):
            begin, _, end = name.partition("~")
            if end and begin.startswith("archive-") and begin <= last and end >= first and not first <= begin <= end <= last:
                raise ValueError(f"the hours {begin} to {end} are folded; load all of them or none")


def hour_load(hour: datetime) -> str:
    return f"archive-{hour:%Y-%m-%d-%H}"
