"""Times the headline queries and the ingest steps; prints one JSON line.

The sample events are first stored the way a user would keep them (month-partitioned events, roll-ups);
queries then run on the stored tables, so pruning and push-down take part. Every entry is the median of
the warm runs after one cold run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import functions as F

from tidemark.operators.admission import sliding_window_admission
from tidemark.operators.normalize import normalize_events
from tidemark.operators.profiles import column_profile, event_type_mix, key_skew, payload_size_profile
from tidemark.operators.rollups import ROLLUP_KEYS, read_rollup, reconcile_rollups, write_rollups
from tidemark.operators.sketches import CORPUS_DAILY, corpus_from_sketches, read_sketches, write_sketches
from tidemark.operators.validate import check_messages, valid_events
from tidemark.plans import activity, cards, completeness, corpus, languages
from tidemark.plans import trending as top
from tidemark.samples.catalog import LANGUAGE, REPO
from tidemark.samples.landing import ARCHIVE_DAY, land_archive_day
from tidemark.samples.tables import AS_OF, bus_messages, enriched_events, raw_lines, sample_events
from tidemark.schema import ACTIVITY, CORRUPT, LANGUAGE_DAILY, MESSAGE, RAW, REPO_STARS_HOURLY
from tidemark.session import build_session
from tidemark.sources.archive import read_archive
from tidemark.sources.bus import read_event_stream
from tidemark.sources.store import read_events, write_events
from tidemark.streaming.ingest import Sinks, start_ingest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = tempfile.mkdtemp(prefix="tidemark-bench-")
    events_path, rollup_root = f"{base}/events", f"{base}/rollups"
    write_events(enriched_events(spark, SF_DIR), events_path, "bench")
    stored = read_events(spark, events_path)
    by_month = read_events(spark, events_path, with_month=True)  # the queries skip months by themselves
    write_rollups(stored, rollup_root, "bench")
    write_sketches(stored, f"{base}/sketches", "bench")
    total = stored.count()
    raw_lines(sample_events(spark, SF_DIR)).select("line").repartition(int(CPUS)).write.option(
        "compression", "gzip"
    ).text(f"{base}/raw")
    bus_messages(sample_events(spark, SF_DIR)).select(
        *[F.col(f.name).cast(f.dataType) for f in MESSAGE.fields]
    ).repartition(4).write.parquet(f"{base}/messages")

    archive = land_archive_day(spark, sample_events(spark, SF_DIR))
    stars = read_rollup(spark, rollup_root, REPO_STARS_HOURLY)

    def recent_stars(window: str):
        return read_rollup(spark, rollup_root, REPO_STARS_HOURLY, start=top.window_start(AS_OF, window))

    langs = read_rollup(spark, rollup_root, LANGUAGE_DAILY)
    cells = read_rollup(spark, rollup_root, ACTIVITY)
    requests = spark.read.parquet(f"{SF_DIR}/events.parquet").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), "ts", F.lit(3).alias("limit")
    )

    def recent(days: int):
        return read_events(spark, events_path, f"2024-01-{31 - days:02d} 00:00:00")

    def raw():
        return spark.read.schema(RAW).option("columnNameOfCorruptRecord", CORRUPT).json(f"{base}/raw")

    def noop(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    serial = iter(range(10_000))

    def stream() -> None:
        n = next(serial)
        start_ingest(
            read_event_stream(spark, files=f"{base}/messages", max_files=4),
            Sinks(f"{base}/stream-{n}"),
            f"{base}/checkpoint-{n}",
            {"availableNow": True},
        ).awaitTermination()

    cases = {
        "trending_rollup_24h": lambda: top.trending(recent_stars("24h"), AS_OF).collect(),
        "trending_rollup_7d": lambda: top.trending(recent_stars("7d"), AS_OF, "7d").collect(),
        "trending_scan_24h": lambda: top.trending_scan(recent(1), AS_OF).collect(),
        "trending_scan_7d": lambda: top.trending_scan(recent(7), AS_OF, "7d").collect(),
        "trending_hour_aligned_24h": lambda: top.trending_hour_aligned(recent(1), AS_OF).collect(),
        "trending_by_language_7d": lambda: top.trending_by_language(recent(7), AS_OF, LANGUAGE, "7d").collect(),
        "trending_page": lambda: top.trending_page(AS_OF, rollup=stars, window="7d", limit=20, after=(60, 50, 10)).collect(),
        "repo_card": lambda: cards.repo_card(stored, stars, REPO).collect(),
        "language_coverage": lambda: languages.language_coverage(by_month, AS_OF).collect(),
        "language_trends": lambda: languages.language_trends(langs, AS_OF).collect(),
        "activity_heatmap": lambda: activity.activity_heatmap(cells).collect(),
        "corpus_stats": lambda: corpus_from_sketches(read_sketches(spark, f"{base}/sketches", CORPUS_DAILY), AS_OF).collect(),
        "corpus_stats_scan": lambda: corpus.corpus_stats(stored, AS_OF).collect(),
        "corpus_stats_exact": lambda: corpus.corpus_stats(stored, AS_OF, exact=True).collect(),
        "missing_hours": lambda: completeness.missing_hours(by_month, "2023-12-30 00:30:00", "2024-02-02 02:15:00").collect(),
        "event_type_mix": lambda: event_type_mix(stored).collect(),
        "key_skew": lambda: key_skew(stored).collect(),
        "payload_size_profile": lambda: payload_size_profile(stored).collect(),
        "column_profile": lambda: column_profile(stored).collect(),
        "reconcile": lambda: reconcile_rollups(
            stored, {n: read_rollup(spark, rollup_root, n) for n in ROLLUP_KEYS}
        ).collect(),
        "admission": lambda: noop(sliding_window_admission(requests, window_seconds=86_400, order="request_id")),
        "normalize_raw_files": lambda: noop(normalize_events(raw())[0]),
        "read_archive_hour": lambda: noop(normalize_events(read_archive(spark, archive, ARCHIVE_DAY))[0]),
        "validate_messages": lambda: noop(valid_events(check_messages(spark.read.parquet(f"{base}/messages")))),
        "store_events": lambda: write_events(stored, f"{base}/again", "bench"),
        "store_rollups": lambda: write_rollups(stored, f"{base}/rollups-again", "bench"),
        "stream_ingest": stream,
    }
    only = set(sys.argv[1:])
    seconds = {}
    for name, run in cases.items():
        if only and name not in only:
            continue
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 4)
    rates = {n: round(total / seconds[n]) for n in ("normalize_raw_files", "store_events", "stream_ingest") if n in seconds}
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "events_per_second": rates,
                "events": total,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
