"""A versioned key-value dimension on shared storage: `<path>/version=N/*.parquet`, each with the keys that changed.

A version is published by one rename, so it exists whole or not at all. The value of a key at version N is the one with the
highest version up to N; a removed key has the empty value. Publishing the same snapshot again adds no version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import _children, _move, _remove

VERSION = "version"


def newest_version(spark: SparkSession, path: str) -> int:
    """0 before the first one."""
    return max([int(v) for v in _children(spark, path, f"{VERSION}=")], default=0)


class Dimension:
    """Values by key (`key BIGINT`, `value STRING` under the names given here)."""

    def __init__(self, spark: SparkSession, path: str, key: str, value: str):
        self.spark, self.path, self.key, self.value = spark, path.rstrip("/"), key, value

    @property
    def newest(self) -> int:
        return newest_version(self.spark, self.path)

    def _history(self, upto: int) -> DataFrame:
        schema = f"{self.key} BIGINT, {self.value} STRING, {VERSION} INT"
        if upto == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).filter(F.col(VERSION) <= upto)

    def _at(self, version: int) -> Column:
        """The value at a version, '' where the key was unknown."""
        known = F.struct(VERSION, self.value)
        return F.coalesce(F.max(F.when(F.col(VERSION) <= version, known))[self.value], F.lit(""))

    def state(self, version: int | None = None) -> DataFrame:
        """All keys with a value at a version, the newest one by default."""
        version = self.newest if version is None else version
        current = self._history(version).groupBy(self.key).agg(self._at(version).alias(self.value))
        return current.filter(F.col(self.value) != "")

    def changes(self, since: int, upto: int) -> DataFrame:
        """Keys whose value differs between two versions, with the value at `upto` ('' if it is gone).

        What changed and changed back is no change. Nothing but the versions' own rows is read.
        """
        both = self._history(upto).groupBy(self.key).agg(
            F.max(VERSION).alias("_last"), self._at(since).alias("_old"), self._at(upto).alias(self.value)
        )
        return both.filter((F.col("_last") > since) & (F.col("_old") != F.col(self.value))).select(self.key, self.value)

    def publish(self, values: DataFrame, whole: bool = True) -> int:
        """Add a version that makes `values` the state; returns the newest version afterwards.

        `whole=False`: keys that are not among `values` stay as they are. Null keys are ignored, null values count as ''; of
        several values of a key the largest counts.
        """
        base = self.newest
        given = (
            values.filter(F.col(self.key).isNotNull())
            .groupBy(F.col(self.key).cast("bigint").alias(self.key))
            .agg(F.coalesce(F.max(self.value), F.lit("")).alias(self.value))
        )
        held = self.state(base).withColumnRenamed(self.value, "_old")
        both = given.join(held, self.key, "full" if whole else "left")
        new, old = F.coalesce(self.value, F.lit("")), F.coalesce("_old", F.lit(""))
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        both.filter(new != old).select(self.key, new.alias(self.value)).write.parquet(draft)
        if self.spark.read.schema(f"{self.key} BIGINT").parquet(draft).isEmpty():
            _remove(self.spark, draft)
            return base
        target = f"{self.path}/{VERSION}={base + 1}"
        if self.newest != base:
            _remove(self.spark, draft)
            raise RuntimeError(f"version {base + 1} of {self.path} was published meanwhile; publish again")
        _move(self.spark, draft, target)
        return base + 1
