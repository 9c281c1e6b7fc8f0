"""Unsigned 64-bit ids in BIGINT columns.

A column holds the 64 bits of an id: ids up to 2^63-1 stand as they are, larger ones are negative. Equality, joins, grouping and
Bloom filters need nothing else. Order does: compare and aggregate `in_order(id)`, which sorts as the unsigned numbers
do. Text, JSON and arithmetic take `to_decimal(id)`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(20,0)"
_HIGH = -(1 << 63)
_HALF, _RANGE = (f"CAST('{1 << bits}' AS {DECIMAL})" for bits in (63, 64))


def _column(id: Column | str) -> Column:
    return F.col(id) if isinstance(id, str) else id


def as_bits(number: int) -> int:
    """An id as it stands in a column; also takes one that was read from a column."""
    if not -(1 << 63) <= number < 1 << 64:
        raise ValueError(f"{number} is no 64-bit id")
    return number - (1 << 64) if number >= 1 << 63 else number


def in_order(id: Column | str) -> Column:
    """BIGINT that sorts as the unsigned id does; applied twice it gives the id again."""
    return _column(id).bitwiseXOR(F.lit(_HIGH))


def largest(id: Column | str) -> Column:
    """MAX over unsigned ids."""
    return in_order(F.max(in_order(id)))


def to_decimal(id: Column | str) -> Column:
    number = _column(id).cast(DECIMAL)
    return F.when(_column(id) < 0, (number + F.expr(_RANGE)).cast(DECIMAL)).otherwise(number)


def to_text(id: Column | str) -> Column:
    return F.when(_column(id) < 0, to_decimal(id).cast("string")).otherwise(_column(id).cast("string"))


def _bits(number: Column) -> Column:
    """A DECIMAL(20,0) as bits; NULL outside 0..2^64-1."""
    low = F.when(number >= F.expr(_HALF), number - F.expr(_RANGE)).otherwise(number)
    return F.when((number >= 0) & (number < F.expr(_RANGE)), low.cast("bigint"))


def of_digits(text: Column) -> Column:
    """Unsigned decimal text to bits; signs, blanks, letters and values above 2^64-1 give NULL."""
    return F.when(text.rlike(r"^[0-9]+$"), F.coalesce(text.try_cast("bigint"), _bits(text.try_cast(DECIMAL))))


def of_number(value: Column) -> Column:
    """A whole JSON number in a VARIANT to bits; other types, negative numbers and values above 2^64-1 give NULL.

    Whole numbers are BIGINT in a VARIANT as long as they fit; a decimal with fewer than 19 digits was written with a point.
    """
    kind = F.schema_of_variant(value)
    small = F.try_variant_get(value, "$", "bigint")
    large = F.when(kind.rlike(r"^DECIMAL\((19|20),0\)$"), _bits(F.try_variant_get(value, "$", DECIMAL)))
    return F.when(kind == "BIGINT", F.when(small >= 0, small)).otherwise(large)
