"""Strict, typed reads out of VARIANT values.

`variant_get` converts freely (5 becomes '5'); these helpers look at the stored type first and give
NULL on a mismatch, so that "absent", "null" and "wrong type" can be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_missing(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def string_value(value: Column) -> Column:
    """NULL unless a JSON string is stored."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def compute_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions later steps must not repeat.

    The optimizer copies a projected expression into every place that uses it, filters included; for a
    JSON parse that multiplies the work. It never looks through a generator, so a generator that emits
    exactly one row pins the value. It stays inside whole-stage code.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
