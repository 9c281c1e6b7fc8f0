"""Sliding-window admission: who would have been let through by a per-key request limit.

A request at time t is admitted if fewer than `limit` requests of its key were admitted in (t - window, t].
Denied requests leave no trace. A denied request learns after how many whole seconds to try again.
Whether a request is admitted depends on earlier admissions, so no window frame can express it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import micros_of

# --- fixed value of the limiter ---
WINDOW_SECONDS = 60
# --- end of fixed value ---
MICROS = 1_000_000


class Held:
    """Admitted times of one key (microseconds, with counts), oldest first; never more than its limit."""

    def __init__(self, window: int, times: Iterable[int] = ()) -> None:
        self.window = window
        self.entries = deque((us, 1) for us in times)
        self.total = len(self.entries)

    def expire(self, us: int) -> None:
        while self.entries and self.entries[0][0] <= us - self.window:
            self.total -= self.entries.popleft()[1]

    def add(self, times: Iterable[int], counts: Iterable[int]) -> None:
        for entry in zip(times, counts, strict=True):
            self.entries.append(entry)
            self.total += entry[1]

    def free_again(self) -> int | None:
        return self.entries[0][0] + self.window if self.entries else None

    def retry_after(self, us):
        """Whole seconds until the oldest admission expires; a whole window if there is none. Takes arrays."""
        free = self.free_again()
        if free is None:
            return self.window // MICROS
        return np.maximum(1, (free - us) // MICROS + 1)

    def offer(self, us: int, limit: int, count: int = 1) -> tuple[int, int]:
        """(how many of `count` requests at `us` are admitted, seconds the others have to wait)."""
        self.expire(us)
        admitted = max(0, min(count, limit - self.total))
        if admitted:
            self.add([us], [admitted])
        return admitted, 0 if admitted == count else max(1, (self.free_again() - us) // MICROS + 1) if self.entries else self.window // MICROS


def walk(held: Held, us: np.ndarray, limit: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decide sorted slots of one key with one limit. Steps are stretches, not slots: what fits is admitted
    at once, and while the window is full everything up to the next expiry is denied at once."""
    admitted, retry = np.zeros_like(n), np.zeros_like(n)
    offered = np.cumsum(n)
    at = 0
    while at < len(us):
        held.expire(int(us[at]))
        free = limit - held.total
        if free <= 0:
            expiry = held.free_again()
            stop = len(us) if expiry is None else int(np.searchsorted(us, expiry, "left"))
            retry[at:stop] = held.retry_after(us[at:stop])
            at = stop
            continue
        stop = int(np.searchsorted(offered, (offered[at - 1] if at else 0) + free, "right"))
        if stop > at:
            admitted[at:stop] = n[at:stop]
            held.add(us[at:stop].tolist(), n[at:stop].tolist())
            at = stop
        else:  # more requests in this instant than places left
            admitted[at], retry[at] = held.offer(int(us[at]), limit, int(n[at]))
            at += 1
    return admitted, retry


def _decide(window: int):
    """Partition function over slots sorted by (key, piece, us, limit). Its state is one `Held`, not a group:
    batches of a long run are decided one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, Held(window)
        for batch in batches:
            if batch.empty:
                continue
            key, piece, us, limit, n = (batch[c].to_numpy() for c in ("key", "piece", "us", "limit", "n"))
            changes = np.flatnonzero((np.diff(key) != 0) | (np.diff(piece) != 0) | (np.diff(limit) != 0)) + 1
            admitted, retry = np.zeros_like(n), np.zeros_like(n)
            for begin, end in pairwise([0, *changes.tolist(), len(batch)]):
                if (key[begin], piece[begin]) != current:
                    current, held = (key[begin], piece[begin]), Held(window)
                part = slice(begin, end)
                admitted[part], retry[part] = walk(held, us[part], int(limit[begin]), n[part])
            decided = batch[["key", "us", "limit", "n"]].assign(admitted=admitted, retry_after=retry)
            yield decided[~batch["seed"].astype(bool)]

    return run


def sliding_window_admission(
    requests: DataFrame,
    key: str = "key",
    ts: str = "ts",
    limit: str | int = "limit",
    window_seconds: int = WINDOW_SECONDS,
    order: str | None = None,
) -> DataFrame:
    """Requests plus `admitted` (boolean) and `retry_after` (seconds, 0 if admitted).

    `key` is BIGINT, `ts` TIMESTAMP_NTZ, `limit` a column or a number; requests of one key at the same
    instant are taken in the order of (`limit`, `order`). A request without key, time or limit is denied
    and told to wait a whole window. How the work is kept parallel for hot keys:

    1. Requests of one key at one instant are interchangeable, so they are counted into slots first.
    2. Time is cut into buckets of one window. If a bucket and the one before it together hold no more
       requests than the limit, everything in the bucket is admitted: no sequential step is needed, and
       what is held at its end is known. Empty buckets are the trivial case.
    3. Only runs of other ("busy") buckets are walked in order, each run on its own, started from the
       calm bucket before it. A walk streams through sorted slots and remembers at most `limit` times.
    """
    if window_seconds < 1:
        raise ValueError("window_seconds must be at least 1")
    window = window_seconds * MICROS
    limit_value: Column = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    bucket = F.floor(F.col("_us") / F.lit(window).cast("decimal(20,0)")).cast("bigint")
    keyed = requests.withColumns({"_key": F.col(key), "_us": micros_of(ts), "_limit": limit_value.cast("bigint")})
    known = keyed.withColumn("_bucket", bucket)
    for column in ("_key", "_us", "_limit", "_bucket"):
        known = known.filter(F.col(column).isNotNull())
    # Both uses of the slots below have the same plan up to the shuffle, so it runs once.
    slots = known.groupBy(
        *[F.col(f"_{c}").alias(c) for c in ("key", "bucket", "us", "limit")]
    ).agg(F.count("*").alias("n"))

    # One row per key and bucket: their number is bounded by time / window, not by requests.
    timeline = Window.partitionBy("key").orderBy("bucket")
    buckets = slots.groupBy("key", "bucket").agg(F.sum("n").alias("demand"), F.min("limit").alias("least_limit"))
    earlier = F.when(F.lag("bucket").over(timeline) == F.col("bucket") - 1, F.lag("demand").over(timeline))
    buckets = buckets.withColumn(
        "calm", F.coalesce(earlier, F.lit(0)) + F.col("demand") <= F.col("least_limit")
    )
    follows_busy = F.coalesce(
        (F.lag("bucket").over(timeline) == F.col("bucket") - 1) & ~F.lag("calm").over(timeline), F.lit(False)
    )
    starts_here = F.when(~F.col("calm") & ~follows_busy, F.col("bucket"))
    feeds_next = (F.lead("bucket").over(timeline) == F.col("bucket") + 1) & ~F.lead("calm").over(timeline)
    run = F.max(starts_here).over(timeline.rowsBetween(Window.unboundedPreceding, 0))
    feeds_next = F.coalesce(F.col("calm") & feeds_next, F.lit(False))
    # Busy buckets belong to the run they stand in, a calm one that feeds a run to the run after it.
    pieces = (
        buckets.select("key", "bucket", "calm", run.alias("run"), feeds_next.alias("feeds_next"))
        .filter("NOT calm OR feeds_next")
        .select(
            "key",
            "bucket",
            F.when(F.col("calm"), F.col("bucket") + 1).otherwise(F.col("run")).alias("piece"),
            F.col("calm").alias("seed"),
        )
    )
    walked = (
        slots.join(pieces, ["key", "bucket"])
        .repartition("key", "piece")
        .sortWithinPartitions("key", "piece", "us", "limit")
        .mapInPandas(_decide(window), "key BIGINT, us BIGINT, limit BIGINT, n BIGINT, admitted BIGINT, retry_after BIGINT")
        .select(
            F.col("key").alias("_key"),
            F.col("us").alias("_us"),
            F.col("limit").alias("_limit"),
            F.col("admitted").alias("_admitted"),
            F.col("retry_after").alias("_retry_after"),
        )
    )

    # What was not walked was calm and is admitted. The instant is part of the join key, so a hot key is
    # spread over all tasks again.
    place = F.row_number().over(
        Window.partitionBy("_key", "_us", "_limit").orderBy(F.col(order) if order else F.lit(0))
    )
    joined = keyed.join(walked, ["_key", "_us", "_limit"], "left").withColumn(
        "_in",
        F.coalesce(place <= F.col("_admitted"), F.lit(True))
        & F.col("_key").isNotNull() & F.col("_us").isNotNull() & F.col("_limit").isNotNull(),
    )
    return joined.select(
        *requests.columns,
        F.col("_in").alias("admitted"),
        F.when(F.col("_in"), F.lit(0))
        .otherwise(F.coalesce("_retry_after", F.lit(window_seconds)))
        .cast("bigint")
        .alias("retry_after"),
    )
