"""Do two results hold the same rows, in any order?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with `surplus` = copies in `a` minus copies in `b`.

    Copies are summed with opposite signs in one grouping: map-side combine, one shuffle, and rows that
    occur very often cost one buffer per task.
    """
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    both = a.withColumn("_sign", F.lit(1).cast("bigint")).union(b.withColumn("_sign", F.lit(-1).cast("bigint")))
    return both.groupBy(*a.columns).agg(F.sum("_sign").alias("surplus")).filter(F.col("surplus") != 0)


def result_fingerprint(rows: DataFrame) -> DataFrame:
    """Row count and order-free hash sum; no shuffle of rows, for results too large to compare."""
    row_hash = F.xxhash64(*[F.col(c) for c in rows.columns]).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_hash), F.lit(0)).alias("hash_sum"))


def results_equivalent(a: DataFrame, b: DataFrame) -> bool:
    return result_differences(a, b).isEmpty()
