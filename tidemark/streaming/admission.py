"""Sliding-window admission on a stream: the admitted times of each key are its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.timestamps import micros_of
from tidemark.operators.admission import MICROS, WINDOW_SECONDS, Held

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Admission(StatefulProcessor):
    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch is bounded by the source, and so is its part of one key.
        batch = pd.concat(list(rows)).sort_values(["us", "request_id"], kind="stable")
        held = Held(self.window, (row[0] for row in self.held.get()))
        decisions = [held.offer(us, limit) for us, limit in zip(batch["us"].tolist(), batch["limit"].tolist(), strict=True)]
        if held.total:
            self.held.put([(us,) for us, count in held.entries for _ in range(count)])
        else:
            self.held.clear()
        yield pd.DataFrame(
            {
                "key": batch["key"],
                "request_id": batch["request_id"],
                "admitted": [a == 1 for a, _ in decisions],
                "retry_after": [r for _, r in decisions],
            }
        )

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Streaming decisions for (key BIGINT, request_id BIGINT, ts TIMESTAMP_NTZ, limit BIGINT).

    State per key is at most `limit` times. Needs the RocksDB state store (see `ROCKSDB`). Requests of a
    batch are decided in time order; a request older than an earlier batch is decided as it arrives.
    """
    return (
        requests.select("key", "request_id", micros_of("ts").alias("us"), "limit")
        .groupBy("key")
        .transformWithStateInPandas(
            _Admission(window_seconds * MICROS),
            "key BIGINT, request_id BIGINT, admitted BOOLEAN, retry_after BIGINT",
            "Append",
            "None",
        )
    )
