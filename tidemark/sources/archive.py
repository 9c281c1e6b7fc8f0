"""Hourly gzip dumps of JSON Lines, one event per line."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.variants import compute_once
from tidemark.schema import CORRUPT, RAW
from tidemark.sources.gzip_lines import Restart, index_files, parts_of, read_gzip_lines
from tidemark.sources.store import write_text

# --- fixed values of the archive format ---
MAX_LINE_BYTES = 8 * 1024 * 1024
# --- end of fixed values ---


def parse_hour(text: str) -> datetime:
    """`YYYY-MM-DD-H`, hour without padding, 0..23."""
    match = re.fullmatch(r"(\d{4}-\d{2}-\d{2})-(\d+)", text)
    if not match:
        raise ValueError(f"expected YYYY-MM-DD-H, got {text!r}")
    hour = int(match[2])
    if hour > 23:
        raise ValueError(f"hour must be 0..23, got {hour}")
    return datetime.strptime(match[1], "%Y-%m-%d") + timedelta(hours=hour)


def hour_range(start: str, end: str) -> list[datetime]:
    """Hours of the half-open range [start, end)."""
    first, last = parse_hour(start), parse_hour(end)
    if last <= first:
        raise ValueError(f"end {end} must be after start {start}")
    return [first + timedelta(hours=i) for i in range(int((last - first) / timedelta(hours=1)))]


def hour_path(base: str, hour: datetime) -> str:
    return f"{base.rstrip('/')}/{hour:%Y-%m-%d}-{hour.hour}.json.gz"


def index_archive(spark: SparkSession, base: str, start: str, end: str | None, path: str, parts: int, every: int = 1 << 25) -> None:
    """Write the restart points of these hours to the file `path`, for reads that cut every hour into `parts` tasks.

    The hours are inflated once, one task each. The driver holds one line per hour, at most `parts` windows of 32 KB in it.
    """
    found = []
    for row in index_files(spark, _files(base, start, end), parts, every).collect():
        restarts = [Restart(a, b, bytes.fromhex(w) if w is not None else None) for a, b, w in json.loads(row.restarts)]
        used = {p.restart.raw_at for p in parts_of(row.file, row.raw_size, restarts, parts)}
        kept = [r for r in json.loads(row.restarts) if r[1] in used]
        found.append({"file": row.file, "raw_size": row.raw_size, "restarts": kept, "parts": parts})
    write_text(spark, path, json.dumps(found))


def _files(base: str, start: str, end: str | None) -> list[str]:
    return [hour_path(base, h) for h in (hour_range(start, end) if end is not None else [parse_hour(start)])]


def read_archive(
    spark: SparkSession, base: str, start: str, end: str | None = None, file_column: str | None = None, index: str | None = None
) -> DataFrame:
    """Raw events of the hours [start, end), or of the one hour `start`, one row per line that is not empty.

    A missing file, a broken gzip stream and a line of MAX_LINE_BYTES or more fail the job. A line that is not one JSON object
    and nothing else (text after it, an array, blanks) becomes a row with its text in the corrupt column. `payload` has
    the source bytes of that member. An hour is one task, or several with an `index` (see `index_archive`). Nothing is
    repartitioned here: the wide raw rows never cross a shuffle, the writer spreads the narrow canonical rows instead.
    `file_column` adds the name of the file each row came from.
    """
    lines = read_gzip_lines(spark, _files(base, start, end), "payload", MAX_LINE_BYTES, index)
    text = F.col("line").cast("string")
    fields = T.StructType([f for f in RAW.fields if f.name != "payload"])
    parsed = compute_once(lines, _raw=F.from_json(F.when(F.col("whole"), text), fields, {"columnNameOfCorruptRecord": CORRUPT}))
    payload = F.col("member").cast("string")
    columns = {f.name: F.col("_raw")[f.name] for f in fields}
    columns["payload"] = F.when(F.col("whole") & (payload != "null"), payload)
    columns[CORRUPT] = F.when(~F.col("whole"), text).otherwise(F.col("_raw")[CORRUPT])
    named = [F.col("file").alias(file_column)] if file_column else []
    return parsed.select(*[columns[f.name].alias(f.name) for f in RAW.fields], *named)
