"""Puts the sample events into the file layouts of the feed, so that the readers have something to read."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.samples.tables import BROKEN, archive_lines, raw_lines
from tidemark.session import work_dir
from tidemark.sources.archive import hour_path, hour_range, parse_hour

PAGE_SIZE = 100


def land_archive(spark: SparkSession, events: DataFrame, start: str, end: str) -> str:
    """One gzip file of raw lines per hour of [start, end), named as the archive names them; see `archive_lines`."""
    base = work_dir(spark, "archive")
    hour = F.concat_ws("-", F.to_date("created_at").cast("string"), F.hour("created_at").cast("string"))
    (
        archive_lines(events)
        .select("line", hour.alias("hour"))
        .repartition(spark.sparkContext.defaultParallelism, "hour")
        .write.partitionBy("hour")
        .option("compression", "gzip")
        .text(f"{base}/by-hour")
    )
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(base).getFileSystem(spark._jsc.hadoopConfiguration())
    written = {}
    for status in fs.globStatus(path_of(f"{base}/by-hour/hour=*/*.gz")):
        path = status.getPath()
        written[path.getParent().getName().removeprefix("hour=")] = path
    for moment in hour_range(start, end):
        target = path_of(hour_path(base, moment))
        source = written.get(f"{moment:%Y-%m-%d}-{moment.hour}")
        if source is not None:
            fs.rename(source, target)
        else:
            out = fs.create(target)
            out.write(bytearray(gzip.compress(b"")))
            out.close()
    return base


ARCHIVE_DAY = "2024-01-01-0"  # the hour under whose name `land_archive_day` puts all events


def land_archive_day(spark: SparkSession, events: DataFrame) -> str:
    """All events in the file of one hour, whose gzip members are the files of as many tasks."""
    base = work_dir(spark, "archive-day")
    archive_lines(events).select("line").write.option("compression", "gzip").text(f"{base}/members")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(base).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path_of(hour_path(base, parse_hour(ARCHIVE_DAY))))
    for status in fs.globStatus(path_of(f"{base}/members/*.gz")):
        source = fs.open(status.getPath())
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out)
        source.close()
    out.close()
    return base


def land_pages(spark: SparkSession, events: DataFrame) -> str:
    """Pages of up to a hundred events, one JSON array per file. A broken line stands in them as a number.

    The tasks write the files themselves: a page is a few KB, and the text writer's cost of a file (two child processes
    that set modes, a checksum file, moves by the driver) was larger than that of its events.
    """
    base = work_dir(spark, "pages")
    element = F.when(F.col("repo_id") == BROKEN, F.lit("5")).otherwise(F.col("line"))
    pages = (
        raw_lines(events)
        .groupBy(F.floor(F.col("event_id") / PAGE_SIZE).alias("page"))
        .agg(F.concat(F.lit("["), F.concat_ws(",\n ", F.collect_list(element)), F.lit("]\n")).alias("text"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else f"file://{base}")
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # A page has one name, whichever attempt writes it; a draft has a name that readers skip.
                draft = f"{folder}/_{page}-{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(text.encode())
                system.move(draft, f"{folder}/page-{page}.txt")
        yield from ()

    path_of = spark._jvm.org.apache.hadoop.fs.Path
    path_of(base).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path_of(base))
    pages.mapInArrow(write, "page BIGINT").write.format("noop").mode("overwrite").save()
    return base
