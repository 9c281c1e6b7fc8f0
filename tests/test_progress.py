"""The engine's own reports of a stream."""

import json
from datetime import datetime
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark.schema import MESSAGE
from tidemark.sources.bus import read_event_stream, to_bus_messages
from tidemark.streaming.audit import read_audit
from tidemark.streaming.ingest import Sinks, replace, start_ingest
from tidemark.streaming.progress import (
    PROGRESS,
    ProgressLog,
    batch_durations,
    fold_progress,
    lag_by_progress,
    progress_rows,
    read_progress,
)

ID = "12345678-9abc-def0-1234-56789abcdef0"


def report(batch, ends=None, latest=None, second=0, name="ingest", **more):
    return {
        "id": ID, "runId": ID, "name": name, "batchId": batch, "timestamp": f"2024-05-06T10:00:{second:02d}.500Z", "numInputRows": 10 * batch,
        "durationMs": {"triggerExecution": 200, "addBatch": 150},
        "sources": [{"startOffset": None, "endOffset": json.dumps(ends) if ends else None, "latestOffset": latest}], **more,
    }


def test_rows_of_reports():
    kafka = progress_rows(report(3, {"events": {"0": 17, "1": 4}}, {"events": {"0": 20, "1": 4}}))
    head = ("123456789abc", 3, datetime(2024, 5, 6, 10), 30, 200, 150)
    assert kafka == [(*head, 0, None, 17, 20), (*head, 1, None, 4, 4)]
    assert progress_rows(report(3)) == [(*head, None, None, None, None)]
    assert progress_rows(report(3, {"logOffset": 2})) == [(*head, None, None, None, None)]
    assert progress_rows(report(3, sources=[{"endOffset": "not json"}])) == [(*head, None, None, None, None)]


def test_lag_and_durations(spark):
    rows = []
    for batch, end in ((1, 5), (2, 9)):
        rows += progress_rows(report(batch, {"events": {"0": end, "1": 4}}, {"events": {"0": 20, "1": 4}}, second=batch))
    frame = spark.createDataFrame(rows, PROGRESS)
    assert {r.partition: r.lag for r in lag_by_progress(frame).collect()} == {0: 11, 1: 0, None: 11}
    row = batch_durations(frame).first()
    assert (row.batches, row.input_rows, row.rows_per_busy_second, row.slowest_trigger_ms) == (2, 30, 75.0, 200)
    assert lag_by_progress(frame.limit(0)).count() == 0 and batch_durations(frame.limit(0)).count() == 0


def reported(progress):
    return SimpleNamespace(progress=SimpleNamespace(json=json.dumps(progress)), name=progress["name"], runId=progress["runId"])


def test_log_writes_loads_once_and_folds(spark, tmp_path):
    sinks = Sinks(str(tmp_path / "out"))
    log = ProgressLog(spark, sinks, every=2)
    log.onQueryStarted(reported(report(0)))
    for batch in range(5):
        log.onQueryProgress(reported(report(batch)))
        log.onQueryProgress(reported(report(batch, name="other")))
    log.onQueryProgress(reported(report(5, durationMs={"triggerExecution": 3})))  # an idle trigger
    assert read_progress(spark, sinks).count() == 4
    log.onQueryTerminated(reported(report(0)))
    log.wait(1)
    assert sorted(r.batch_id for r in read_progress(spark, sinks).collect()) == [0, 1, 2, 3, 4]
    fold_progress(spark, replace(sinks, stream="123456789abc"), 4)
    fold_progress(spark, replace(sinks, stream="123456789abc"), 5)
    assert sorted(r.batch_id for r in read_progress(spark, sinks).collect()) == [0, 1, 2, 3, 4]


def test_reports_of_an_ingest_that_ran(spark, event, tmp_path):
    folder = tmp_path / "messages"
    for part in range(3):
        rows = to_bus_messages(event(*[{}] * (part + 2))).collect()
        data = [(r.key, r.value, "events", part, i, None) for i, r in enumerate(rows)]
        spark.createDataFrame(data, MESSAGE).coalesce(1).write.mode("append").parquet(str(folder))
    sinks = Sinks(str(tmp_path / "out"))
    log = ProgressLog(spark, sinks)
    spark.streams.addListener(log)
    try:
        stream = read_event_stream(spark, files=str(folder), max_files=1)
        query = start_ingest(stream, sinks, str(tmp_path / "checkpoint"), {"availableNow": True})
        query.awaitTermination()
        log.wait()
    finally:
        spark.streams.removeListener(log)
    reports = {r.batch_id: r for r in read_progress(spark, sinks).collect()}
    counted = {r.batch_id: r.n for r in read_audit(spark, sinks.audit).groupBy("batch_id").agg(F.sum("consumed").alias("n")).collect()}
    assert {b: r.input_rows for b, r in reports.items()} == counted and sum(counted.values()) == 9
    assert all(r.stream == query.id.replace("-", "")[:12] and r.trigger_ms >= r.add_batch_ms > 0 for r in reports.values())
