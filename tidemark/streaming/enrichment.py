"""Languages of stored events: whole months at once, or just what a new version of the dimension touches.

The folder of an event load holds a mark `_language=N`: its events have the languages of version N. Whatever writes the folder
anew (a replay, a reload) takes the mark away with the old files, so such a load counts as never enriched. Rewritten loads keep
their names, and so do their parts of the language roll-up: a batch that runs again replaces its own rows only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.enrich import enrich_language
from tidemark.operators.reconcile import rewrite_fingerprints
from tidemark.operators.rollups import ROLLUP_KEYS, language_daily, rollup_path
from tidemark.schema import CANONICAL_COLUMNS, LANGUAGE_DAILY
from tidemark.sources.dimension import Dimension
from tidemark.sources.store import (
    EVENT_BLOOM,
    EVENT_ORDER,
    EVENTS_DDL,
    LOAD,
    MONTH,
    _files_in,
    _remove,
    write_text,
    exists,
    finish_replacements,
    load_path,
    month_loads,
    newest_batches,
    read_table,
    replace_loads,
    stored_months,
)
from tidemark.streaming.ingest import Sinks

MARK = "_language="
Folder = tuple[int, str]


def languages_of(spark: SparkSession, path: str) -> Dimension:
    """The repository languages, a dimension with versions."""
    return Dimension(spark, path, "repo_id", "language")


def _in_folders(folders: Iterable[Folder]) -> Column:
    """Only these loads of these months. All of it is about partition columns, so other folders are not read."""
    loads: dict[int, list[str]] = defaultdict(list)
    for month, load in folders:
        loads[month].append(load)
    found = F.lit(False)
    for month, names in loads.items():
        found = found | ((F.col(MONTH) == month) & F.col(LOAD).isin(names))
    return found


def _rewrite(spark: SparkSession, sinks: Sinks, folders: list[Folder], enriched: DataFrame) -> None:
    replace_loads(enriched, sinks.events, folders, EVENT_ORDER, ["event_type"], EVENT_BLOOM)


def _rebuild_rollup(spark: SparkSession, sinks: Sinks, folders: list[Folder]) -> None:
    """The loads' parts of the language roll-up, from their stored events."""
    path = rollup_path(sinks.rollups, LANGUAGE_DAILY)
    finish_replacements(spark, path)
    stored = read_table(spark, sinks.events, EVENTS_DDL, sorted({m for m, _ in folders})).filter(_in_folders(folders))
    replace_loads(language_daily(stored, MONTH, LOAD), path, folders, ROLLUP_KEYS[LANGUAGE_DAILY], [])
    if exists(spark, sinks.fingerprints):
        finish_replacements(spark, sinks.fingerprints)
        rewrite_fingerprints(stored, sinks.fingerprints, folders)


def _mark(spark: SparkSession, sinks: Sinks, folders: Iterable[Folder], version: int) -> None:
    for month, load in folders:
        folder = load_path(sinks.events, month, load)
        old = [f for f in _files_in(spark, folder) if f.startswith(MARK) and f != f"{MARK}{version}"]
        write_text(spark, f"{folder}/{MARK}{version}", "")
        for name in old:
            _remove(spark, f"{folder}/{name}")


def enriched_versions(spark: SparkSession, sinks: Sinks, running: bool = False) -> dict[Folder, int]:
    """The version of every stored load, 0 for one that was never enriched.

    With `running` streams each stream's newest batch is left out: it may be in the middle of being written.
    """
    found: dict[Folder, int] = {}
    loads = {month: month_loads(spark, sinks.events, month) for month in stored_months(spark, sinks.events)}
    open_loads = newest_batches(n for names in loads.values() for n in names) if running else set()
    for month, names in loads.items():
        for name in names:
            files = _files_in(spark, load_path(sinks.events, month, name))
            if name not in open_loads and any(not f.startswith(("_", ".")) for f in files):
                marks = [int(f.removeprefix(MARK)) for f in files if f.startswith(MARK)]
                found[month, name] = max(marks, default=0)
    return found


def enrich_changed(spark: SparkSession, sinks: Sinks, languages: Dimension, running: bool = False) -> list[Folder]:
    """Bring all stored events to the newest version of their languages; returns the loads that were rewritten.

    A load at version v is rewritten only if one of its repositories changed its language since v; finding out reads the
    repository column of such loads, against the changed repositories alone. Loads without a mark (new or late batches,
    replays, loads a crash left half done) are compared with the whole state. A load's mark is set last, so a
    call after a crash goes on where the last one stopped, and repeating a call does nothing. Give `running` while streams
    write: their newest batches then wait for the next call.
    """
    finish_replacements(spark, sinks.events)
    version = languages.newest
    stale: dict[int, list[Folder]] = defaultdict(list)
    for folder, held in enriched_versions(spark, sinks, running).items():
        if held < version:
            stale[held].append(folder)
    rewritten: list[Folder] = []
    for held, folders in sorted(stale.items()):
        if held:
            changed = languages.changes(held, version).withColumnRenamed("language", "_new")
            kept = F.col("language")
        else:
            changed = languages.state(version).withColumnRenamed("language", "_new")
            kept = F.lit("")
        stored = read_table(spark, sinks.events, EVENTS_DDL, sorted({m for m, _ in folders})).filter(_in_folders(folders))
        if held:
            differing = stored.join(changed, "repo_id", "left_semi")
        else:
            differing = stored.join(changed, "repo_id", "left").filter(F.coalesce("_new", F.lit("")) != F.col("language"))
        touched = sorted((r[0], r[1]) for r in differing.select(MONTH, LOAD).distinct().collect())
        by_month: dict[int, list[Folder]] = defaultdict(list)
        for folder in touched:
            by_month[folder[0]].append(folder)
        for month, own in by_month.items():
            rows = stored.filter(F.col(MONTH) == month).filter(_in_folders(own)).join(changed, "repo_id", "left")
            language = F.coalesce("_new", kept).alias("language")
            _rewrite(spark, sinks, own, rows.select(*[language if c == "language" else c for c in CANONICAL_COLUMNS], MONTH, LOAD))
        # A load without a mark may have its languages from a call that ended before the roll-up was written.
        rebuilt = folders if held == 0 else touched
        for month in sorted({m for m, _ in rebuilt}):
            own = [f for f in rebuilt if f[0] == month]
            _rebuild_rollup(spark, sinks, own)
            _mark(spark, sinks, own, version)
        _mark(spark, sinks, [f for f in folders if f not in set(rebuilt)], version)
        rewritten += touched
    return rewritten


def enrich_months(spark: SparkSession, sinks: Sinks, languages: DataFrame, months: list[int]) -> None:
    """Give all events of some months their languages from a plain lookup, and rebuild these months of the language roll-up.

    Loads keep their names, so repeating the step, also after a crash, and replays of batches give the same tables; a
    replayed batch is without languages until the next call. `enrich_changed` does less work where languages have versions.
    """
    finish_replacements(spark, sinks.events)
    for month in months:
        own = [(month, name) for name in month_loads(spark, sinks.events, month)]
        if not own:
            continue
        rows = read_table(spark, sinks.events, EVENTS_DDL, [month]).withColumn("language", F.lit(""))
        _rewrite(spark, sinks, own, enrich_language(rows, languages, keep=(MONTH, LOAD)))
        _rebuild_rollup(spark, sinks, own)
