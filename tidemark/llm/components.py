"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import work_dir

MOST_ROUNDS = 100


def _stars(edges: DataFrame, only_smaller: bool) -> DataFrame:
    """Connect the neighbours of each node (all larger ones, or the smaller ones) to the least node around it."""
    around = edges if only_smaller else edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    around = around.select(F.col("high").alias("node"), F.col("low").alias("near"))
    least = around.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    joined = around.join(least, "node")
    moved = joined.filter(F.col("near") > F.col("node")).select("near", "least") if not only_smaller else (
        joined.select("near", "least").unionByName(least.select(F.col("node").alias("near"), "least"))
    )
    return moved.filter(F.col("near") != F.col("least")).select(F.col("near").alias("high"), F.col("least").alias("low")).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of at least one edge between two nodes; component is the least node reachable.

    Every round is written to the shared work folder, so a lost executor costs one round; a node with many neighbours
    is met by partial aggregation and a join that adaptive execution splits. Stops when a round changes nothing.
    """
    spark = edges.sparkSession
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    current = edges.filter(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    before = None
    for _ in range(MOST_ROUNDS):
        path, seen = work_dir(spark, "components"), Observation()
        mark = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        current.observe(seen, F.count("*").alias("n"), mark.alias("mark")).write.parquet(path)
        current = spark.read.schema("high BIGINT, low BIGINT").parquet(path)
        now = (seen.get["n"], seen.get["mark"])
        if now == before or now[0] == 0:
            break
        before = now
        current = _stars(_stars(current, only_smaller=False), only_smaller=True)
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return current.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)
