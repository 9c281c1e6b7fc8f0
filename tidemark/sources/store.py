"""Tables on shared storage: `<path>/ym=YYYYMM/load=<name>/*.parquet`.

Every write is a named load. Running a load again replaces exactly its own folders (dynamic partition
overwrite, then removal of folders it no longer fills), so a replayed batch leaves neither duplicate
events nor doubled sums. Finished batches of a stream are folded into one load per month. A month is the unit
of pruning, reload and deletion.

What replaces stored loads is finished beside the table first, under `_replacing`, with a list of the folders it stands
for; a call after a crash takes up what it finds there. Names that begin with an underscore are invisible to readers.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import as_utc, month_number, months_between, ts_lit, utc_now
from tidemark.schema import CANONICAL, CANONICAL_COLUMNS, DEAD_LETTER_COLUMNS

MONTH = "ym"
LOAD = "load"
EVENTS_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CANONICAL.fields)
EVENT_ORDER = ["event_type", "created_at", "repo_id"]
EVENT_BLOOM = ["repo_name", "repo_id"]
DEAD_LETTERS = "key STRING, value STRING, error STRING, error_type STRING, source_partition INT, source_offset BIGINT"


def _writer(frame: DataFrame, bloom: list[str]):
    writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        # The table decides how many values a row group really holds; the filter shrinks to fit.
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    return writer


def write_table(
    frame: DataFrame,
    path: str,
    load: str | tuple[str, str],
    spread: list[str],
    order: list[str],
    bloom: list[str] | None = None,
) -> None:
    """Write rows that carry a `ym` column as one load, or as the loads from..to that their `load` column names.

    REBALANCE shuffles by month plus the leading sort columns. Adaptive execution then cuts groups that
    are too large (a month with one dominating type) and merges small ones, so file sizes follow the
    advisory partition size and no month ever has to fit one task. The local sort puts equal values next
    to each other: row groups get narrow min/max ranges for the readers to skip by.

    Afterwards the loads hold what this write produced and nothing else: folders of theirs that an earlier
    run had filled and this one did not touch are removed.
    """
    spark = frame.sparkSession
    first, last = (load, load) if isinstance(load, str) else load
    if isinstance(load, str):
        frame = frame.withColumn(LOAD, F.lit(load))
    else:
        spread, order = [LOAD, *spread], [LOAD, *order]
    before = _load_files(spark, path, first, last)
    held = [_month_of(folder) for folder, files in before.items() if REPLACED in files]
    if held:  # a replay of a batch whose rows of these months are part of what replaced them
        frame = frame.filter(~F.col(MONTH).isin(held))
    (
        _writer(
            frame.hint("rebalance", *[F.col(c) for c in [MONTH, *spread]]).sortWithinPartitions(MONTH, *order),
            bloom or [],
        )
        .partitionBy(MONTH, LOAD)
        .parquet(path)
    )
    after = _load_files(spark, path, first, last)
    for folder, files in before.items():
        if after.get(folder) == files and REPLACED not in files:
            _remove(spark, folder)


def write_events(events: DataFrame, path: str, load: str | tuple[str, str] | None = None) -> None:
    """Append canonical events in their fixed column order; give a `load` name to make a rerun safe."""
    loads = [LOAD] if isinstance(load, tuple) else []
    write_table(
        events.select(*CANONICAL_COLUMNS, *loads).withColumn(MONTH, month_number("created_at")),
        path,
        load or f"append-{uuid.uuid4().hex}",
        spread=["event_type"],
        order=EVENT_ORDER,
        bloom=EVENT_BLOOM,
    )


def read_table(spark: SparkSession, path: str, schema: str, months: list[int] | None = None) -> DataFrame:
    """Rows of a table with their `ym`; `months` prunes folders."""
    rows = spark.read.schema(f"{schema}, {MONTH} INT, {LOAD} STRING").parquet(path)
    if months is not None:
        rows = rows.filter(F.col(MONTH).isin(months) if months else F.lit(False))
    return rows


def read_events(
    spark: SparkSession,
    path: str,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    with_month: bool = False,
) -> DataFrame:
    """Canonical events of [start, end). The time bounds are repeated on the month column, because
    Spark cannot derive a folder from a predicate on `created_at`. `with_month` keeps that column, so that
    queries with bounds of their own can skip months too."""
    rows = read_table(spark, path, EVENTS_DDL)
    bounds: list[Column] = []
    if start is not None:
        s = as_utc(start)
        bounds += [F.col(MONTH) >= s.year * 100 + s.month, F.col("created_at") >= ts_lit(s)]
    if end is not None:
        e = as_utc(end)
        bounds += [F.col(MONTH) <= e.year * 100 + e.month, F.col("created_at") < ts_lit(e)]
    if start is not None and end is not None:
        bounds.append(F.col(MONTH).isin(months_between(as_utc(start), as_utc(end)) or [0]))
    for bound in bounds:
        rows = rows.filter(bound)
    return rows.select(*CANONICAL_COLUMNS, *([MONTH] if with_month else []))


def write_dead_letters(letters: DataFrame, path: str, load: str | None = None) -> None:
    """Append dead letters, bytes and key unchanged, to the month they arrived in. Nothing here ever replays them."""
    rows = letters.select(*DEAD_LETTER_COLUMNS).withColumn(MONTH, month_number(utc_now()))
    write_table(rows, path, load or f"append-{uuid.uuid4().hex}", [], ["source_partition", "source_offset"])


def read_dead_letters(spark: SparkSession, path: str, months: list[int] | None = None) -> DataFrame:
    """No rows where nothing was ever poisoned."""
    if not exists(spark, path):
        return spark.createDataFrame([], DEAD_LETTERS)
    return read_table(spark, path, DEAD_LETTERS, months).select(*DEAD_LETTER_COLUMNS)


# Whole months ------------------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _folder(spark, path)
    return fs.exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    fs, target = _folder(spark, path)
    fs.delete(target, True)


def month_path(path: str, month: int) -> str:
    return f"{path.rstrip('/')}/{MONTH}={month}"


def drop_month(spark: SparkSession, path: str, month: int) -> None:
    """Delete one month of a table; other months are not touched."""
    _remove(spark, month_path(path, month))


def replace_month(
    rows: DataFrame,
    path: str,
    month: int,
    load: str,
    order: list[str],
    spread: list[str],
    bloom: list[str] | None = None,
) -> None:
    """Make `rows` (without `ym`) the whole content of one month, whatever loads it had before.

    Rerunning gives the same table, and rows may be read from the month they replace; after a crash call
    `finish_replacements` before reading them (see `_nothing_pending`). A stream may
    still run its newest batch again: a note in that load's folder says that the month has its rows already,
    and the replay leaves this month out. Do not call it while a stream writes into the month.
    """
    spark = rows.sparkSession
    _nothing_pending(spark, path)
    old = [name for name in month_loads(spark, path, month) if name != load]
    notes = newest_batches(old)
    _replace(
        rows.withColumn(MONTH, F.lit(month)).withColumn(LOAD, F.lit(load)),
        path,
        [(month, load)],
        order,
        spread,
        bloom,
        {(month, name): name in notes for name in old},
    )


def replace_loads(
    rows: DataFrame,
    path: str,
    folders: Iterable[tuple[int, str]],
    order: list[str],
    spread: list[str],
    bloom: list[str] | None = None,
) -> None:
    """Make `rows` (with `ym` and `load`) the whole content of these (month, load) folders; all others stay.

    The loads keep their names, so a batch that runs again replaces its own rows as ever. A load `a~b` also takes the place
    of the loads a..b it holds. Folders without rows are removed. Rows may be read from the folders they replace; after a crash
    call `finish_replacements` before reading them.
    """
    _nothing_pending(rows.sparkSession, path)
    _replace(rows, path, folders, order, spread, bloom, {})


# Replacing and folding loads ---------------------------------------------------------------------------

REPLACING = "_replacing"
REPLACED = "_replaced"  # the note in the folder of a batch whose rows a month has already
FILLED, OLD, NOTE = "filled", "old", "note"
_BATCH = re.compile(r"(.+)-(\d{12})")


def _replace(rows, path, folders, order, spread, bloom, also: dict[tuple[int, str], bool]) -> None:
    spark, folders = rows.sparkSession, list(folders)
    base = f"{path.rstrip('/')}/{REPLACING}"
    draft = f"{base}/draft-{uuid.uuid4().hex}"
    (
        _writer(
            rows.hint("rebalance", *[F.col(c) for c in [MONTH, LOAD, *spread]]).sortWithinPartitions(MONTH, LOAD, *order),
            bloom or [],
        )
        .partitionBy(MONTH, LOAD)
        .parquet(draft)
    )
    def line(state: str, month: int, load: str) -> str:
        return f"{state}\t{month}\t{load}\t{','.join(sorted(_files_in(spark, load_path(path, month, load))))}"

    lines = [line(NOTE if note else OLD, m, n) for (m, n), note in also.items()]
    for month, load in folders:
        held = [n for n in month_loads(spark, path, month) if _holds(load, n)] if "~" in load else [load]
        lines += [line(OLD, month, name) for name in held]
    # Old folders go first: a new one may bear a name that lies in the range of an old one.
    lines += [line(FILLED, m, n) for m, n in folders if exists(spark, load_path(draft, m, n))]
    write_text(spark, f"{draft}/{REPLACING}", "\n".join(lines))
    _move(spark, draft, f"{base}/ready-{uuid.uuid4().hex}")
    finish_replacements(spark, path)


def _nothing_pending(spark: SparkSession, path: str) -> None:
    """Between a crash and the next call folders may be missing, and rows that were read then would be saved as the whole."""
    if finish_replacements(spark, path):
        raise RuntimeError(f"an interrupted replacement in {path} has been completed; read the rows again")


def finish_replacements(spark: SparkSession, path: str) -> bool:
    """Put finished replacements in the place of the loads they stand for.

    A folder that was written anew since the replacement was made (its files have other names) is left alone: it is newer.
    Returns whether there were any.
    """
    fs, _ = _folder(spark, path)
    base = f"{path.rstrip('/')}/{REPLACING}"
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/ready-*")) or []
    for status in found:
        ready = status.getPath().toString()
        for line in filter(None, read_text(spark, f"{ready}/{REPLACING}").split("\n")):
            state, month, load, files = line.split("\t")
            source, target = load_path(ready, int(month), load), load_path(path, int(month), load)
            if state == FILLED:
                if exists(spark, source) and not exists(spark, target):  # else an earlier call has moved it, or it is out of date
                    _move(spark, source, target)
            elif state == NOTE:  # whatever the batch has written here again is part of the new rows
                _remove(spark, target)
                write_text(spark, f"{target}/{REPLACED}", "")
            elif ",".join(sorted(_files_in(spark, target))) == files:
                _remove(spark, target)
        _remove(spark, ready)
    return bool(found)


def _holds(load: str, name: str) -> bool:
    first, _, last = load.partition("~")
    return name == load if not last else first <= name <= f"{last}~"


def load_path(path: str, month: int, load: str) -> str:
    return f"{month_path(path, month)}/{LOAD}={load}"


def _month_of(folder: str) -> int:
    return int(folder.rpartition(f"{MONTH}=")[2].partition("/")[0])


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows `prefix` in the names of a folder's subfolders."""
    if not exists(spark, path):
        return []
    fs, target = _folder(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    return sorted(name.removeprefix(prefix) for name in names if name.startswith(prefix))


def stored_months(spark: SparkSession, path: str) -> list[int]:
    return [int(m) for m in _children(spark, path, f"{MONTH}=")]


def month_loads(spark: SparkSession, path: str, month: int) -> list[str]:
    return _children(spark, month_path(path, month), f"{LOAD}=")


def newest_batches(loads: Iterable[str]) -> set[str]:
    """Of each stream the load of its newest batch: the only one that Spark may still run again."""
    newest: dict[str, str] = {}
    for name in sorted(loads):
        match = _BATCH.fullmatch(name)
        if match:
            newest[match[1]] = name
    return set(newest.values())


def _files_in(spark: SparkSession, folder: str) -> frozenset[str]:
    fs, target = _folder(spark, folder)
    return frozenset(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else frozenset()


def _load_files(spark: SparkSession, path: str, first: str, last: str) -> dict[str, frozenset[str]]:
    """Folders of the loads first..last (by name) in all months, with the names of their files.

    The folder of a single load is looked up in each month by its path, whatever other loads are there.
    """
    found = {}
    for month in stored_months(spark, path):
        names = [first] if first == last else [n for n in month_loads(spark, path, month) if first <= n <= last]
        for folder in (load_path(path, month, name) for name in names):
            files = _files_in(spark, folder)
            if files:
                found[folder] = files
    return found


def has_loads(spark: SparkSession, path: str, first: str, last: str) -> bool:
    return bool(_load_files(spark, path, first, last))


def batch_load(stream: str, batch_id: int) -> str:
    return f"{stream}-{batch_id:012d}"


def fold_batches(
    spark: SparkSession,
    path: str,
    schema: str,
    stream: str,
    below: int,
    order: list[str],
    spread: list[str],
    bloom: list[str] | None = None,
    change: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Merge the batches of a stream with ids under `below` into one load per month.

    `below` is the last committed batch: it may still be replayed and stays as it is, older ones are never
    written again.
    """
    fold_loads(spark, path, schema, batch_load(stream, 0), batch_load(stream, below - 1), order, spread, bloom, change)


def fold_loads(
    spark: SparkSession,
    path: str,
    schema: str,
    first: str,
    last: str,
    order: list[str],
    spread: list[str],
    bloom: list[str] | None = None,
    change: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Merge the loads first..last (by name) into one load `first~last` per month.

    The name says which loads it holds, in every table alike. Whatever is loaded meanwhile is not among what goes.
    """
    finish_replacements(spark, path)
    merged = f"{first}~{last}"
    for month in stored_months(spark, path):
        names = [n for n in month_loads(spark, path, month) if _holds(merged, n)]
        if len(names) < 2:
            continue
        rows = read_table(spark, path, schema, [month]).filter(F.col(LOAD).isin(names)).drop(MONTH, LOAD)
        rows = (change(rows) if change else rows).select(*rows.columns)
        rows = rows.withColumn(MONTH, F.lit(month)).withColumn(LOAD, F.lit(merged))
        _replace(rows, path, [(month, merged)], order, spread, bloom, {})


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, goal = _folder(spark, target)
    fs.mkdirs(goal.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), goal):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _folder(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _folder(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def fold_events(spark: SparkSession, path: str, stream: str, below: int) -> None:
    """Merge the many small files of a stream's finished batches into large sorted ones; rows stay the same."""
    fold_batches(spark, path, EVENTS_DDL, stream, below, EVENT_ORDER, ["event_type"], EVENT_BLOOM)
