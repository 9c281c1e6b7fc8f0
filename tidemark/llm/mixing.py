"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source gets a target number of words from its weight. Its documents stand in a queue in shuffled order, once per
pass; a document's virtual finish time is the words of its source up to and including it, divided by the target. All
queues together are ordered by finish time and cut where the total budget is used up; a document that would start after
its source has reached its target (time 1) is not in the order, so no source overshoots by more than one document.

Nothing is gathered by source. Running sums are built from the sums of hash ranges (a hot source is spread over 4096 of
them). Everything that finishes by time 1 fits the budget by construction, so of the global order only the one document
per source around time 1 has to be sorted. As a source is always taken as a prefix of its queue, the outcome is one row
per source (the last place taken), and whole rows are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.columns import unused
from tidemark.session import work_dir

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MOST_PASSES = 2
SEED = "mix-1"
RANGES = 4096

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def queue_place(doc_id: str, text: str, seed: str) -> tuple[Column, Column]:
    """Place in the shuffled order: a seeded hash of the id, then a hash of the text."""
    first = _hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))))
    return first, _hash60(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Add `weight` and `target` to (source, source_size).

    Sources by code point, null last, take the weights in turn. No target is above `most` times its source's size: with
    sources ordered by size over weight those at their limit are a prefix, so one pass of running sums gives the level
    that the others share by weight. One row per source; this table alone is ordered in one task.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(float(most)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    leveled = ranked.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    ).withColumn("limited", F.col("most") <= F.col("weight") * F.col("level"))
    shared = F.min(F.when(~F.col("limited"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"]
    return leveled.withColumn(
        "target", F.when(F.col("limited"), F.col("most")).otherwise(F.col("weight") * shared)
    ).select("source", "source_size", "weight", "target")


def _queue(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    first, second = queue_place(doc_id, text, seed)
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{source}`").alias("source"),
        first.alias("h1"),
        second.alias("h2"),
        word_count(text).alias("size"),
    )


def plan_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = BUDGET_SHARE,
    most_passes: int = MOST_PASSES,
    seed: str = SEED,
) -> DataFrame:
    """One row per source: source_size, target and `last`, the last (pass, h1, h2, row) taken; null if nothing is."""
    spark = docs.sparkSession
    path = work_dir(spark, "mix")
    _queue(docs, doc_id, text, source, seed).write.parquet(path)  # narrow; read twice below
    queue = spark.read.parquet(path).withColumn("range", F.floor(F.col("h1") / F.lit((1 << 60) // RANGES)))

    ranges = queue.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sources = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_passes)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    totals = sources.select(F.col("source").alias("ts"), "source_size", "target")
    # Rows equal in id, source and text follow each other by their place in the input.
    within = Window.partitionBy("source", "range").orderBy("h1", "h2", "row")
    placed = (
        queue.withColumn("upto", F.sum("size").over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .join(totals, F.col("source").eqNullSafe(F.col("ts")))
        .filter((F.col("target") > 0) & (F.col("size") > 0))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))))
        .withColumn("reached", F.col("pass") * F.col("source_size") + F.col("offset") + F.col("upto"))
        .withColumn("finish", F.col("reached") / F.col("target"))
        .filter((F.col("reached") - F.col("size")) / F.col("target") < 1)
        .withColumn("place", F.struct("pass", "h1", "h2", "row"))
    )
    in_time = F.col("finish") <= 1
    ends = placed.groupBy(F.col("source").alias("ls")).agg(
        F.max(F.when(in_time, F.col("place"))).alias("last"),
        F.coalesce(F.sum(F.when(in_time, F.col("size"))), F.lit(0)).alias("words"),
        F.max(F.when(~in_time, F.col("place"))).alias("next"),
        F.sum(F.when(~in_time, F.col("size"))).alias("next_words"),
        F.max(F.when(~in_time, F.col("finish"))).alias("next_finish"),
    )
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_finish = Window.orderBy(F.col("next_finish").asc_nulls_last(), F.col("source").asc_nulls_last())
    fits = F.sum("words").over(everything) + F.sum("next_words").over(by_finish) <= F.lit(float(share)) * F.sum(
        "source_size"
    ).over(everything)
    return sources.join(ends, F.col("source").eqNullSafe(F.col("ls")), "left").select(
        "source", "source_size", "weight", "target",
        F.when(F.col("next").isNotNull() & fits, F.col("next")).otherwise(F.col("last")).alias("last"),
    )


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **plan) -> DataFrame:
    """Add to every row a struct `mix`: size, source_size, weight, target and `copies`, how often the mix takes it.

    A null or empty text has size 0 and is taken with its neighbours in the queue at no cost. Sources may be null (they
    are one source, last in order). Rows equal in id, source and text follow each other in the queue, in the order of the
    input's files; where the cut falls among them some are taken once more often than the others. A
    source with no words has target 0 and gives no copies; an empty table gives no rows. The order of rows and files
    decides between equal rows only, so reruns agree. An existing column `mix` is replaced, others stay whatever their names.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "mix-plan")
    plan_mix(docs, doc_id, text, source, seed=seed, **plan).write.parquet(path)
    # Read back, the plan has a measured size: Spark broadcasts it if that is small and shuffles otherwise.
    size, h1, h2, row, *kept = unused(docs, "size", "h1", "h2", "row", "source", "source_size", "weight", "target", "last")
    per_source = spark.read.parquet(path).select("source", "source_size", "weight", "target", "last").toDF(*kept)
    of_source, source_size, weight, target, last = kept
    first, second = queue_place(doc_id, text, seed)
    copies = F.lit(0)
    for number in range(plan.get("most_passes", MOST_PASSES)):
        place = F.struct(F.lit(number).alias("pass"), F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.col(row).alias("row"))
        copies = copies + F.coalesce(place <= F.col(last), F.lit(False)).cast("int")
    measured = docs.drop("mix").withColumns(
        {row: F.monotonically_increasing_id(), size: word_count(text), h1: first, h2: second}
    )
    joined = measured.join(per_source, F.col(f"`{source}`").eqNullSafe(F.col(of_source)), "left")
    names = {size: "size", source_size: "source_size", weight: "weight", target: "target"}
    mix = F.struct(*[F.col(c).alias(n) for c, n in names.items()], copies.cast("bigint").alias("copies"))
    return joined.withColumn("mix", mix).select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"], "mix")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns it came with."""
    own, copy = unused(docs, "mix", "copy")
    mixed = mix_sources(docs.withColumnRenamed("mix", own), **options)
    repeated = mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int"))))
    return repeated.drop("mix", copy).withColumnRenamed(own, "mix").select(*[F.col(f"`{c}`") for c in docs.columns])
