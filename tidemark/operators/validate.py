"""Canonical messages: parse, check the contract, split off poison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timestamps import parse_rfc3339
from tidemark.functions.unsigned import of_number
from tidemark.functions.variants import compute_once, string_value
from tidemark.schema import CANONICAL, CANONICAL_COLUMNS, ID_COLUMNS

# --- fixed values of the dead-letter format ---
POISON_ERROR_TYPE = "PoisonMessageError"
# --- end of fixed values ---

PLACE_COLUMNS = ["partition", "offset"]


_KINDS = {T.LongType: "an integer", T.StringType: "a string", T.TimestampNTZType: "a timestamp"}
# Sizes are parsed strictly, a mismatch gives NULL; texts and ids are VARIANT so that their type shows.
_DOCUMENT = T.StructType(
    [
        T.StructField(f.name, f.dataType if isinstance(f.dataType, T.LongType) and f.name not in ID_COLUMNS else T.VariantType())
        for f in CANONICAL.fields
    ]
)


def _typed(value: Column, field: T.StructField) -> Column:
    """The field's value, NULL if it is missing, null or of another type."""
    kind = field.dataType
    if isinstance(kind, T.LongType):
        return of_number(value) if field.name in ID_COLUMNS else value
    text = string_value(value)
    return parse_rfc3339(text) if isinstance(kind, T.TimestampNTZType) else text


def check_messages(messages: DataFrame) -> DataFrame:
    """Messages plus the canonical columns and `error` (NULL = valid).

    A JSON parser stops at the end of the first object. Text after it is noticed by counting the value
    as an array: it has one element exactly if nothing follows.
    """
    text = F.when(F.is_valid_utf8("value"), F.col("value"))
    whole = F.coalesce(F.ltrim(text).startswith("{") & F.rtrim(text).endswith("}"), F.lit(False)) & F.coalesce(
        F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False)
    )
    parsed = compute_once(messages, _whole=whole, _doc=F.from_json(text, _DOCUMENT))
    typed = compute_once(parsed, **{f.name: _typed(F.col("_doc")[f.name], f) for f in CANONICAL.fields})
    failing = F.coalesce(*[F.when(F.col(f.name).isNull(), f.name) for f in CANONICAL.fields])
    kinds = F.create_map(*[F.lit(v) for f in CANONICAL.fields for v in (f.name, _KINDS[type(f.dataType)])])
    absent = F.call_function("get_json_object", text, F.concat(F.lit("$."), failing)).isNull()
    error = (
        F.when(~F.col("_whole"), "value is not a JSON object")
        .when(
            failing.isNotNull(),
            F.concat(failing, F.when(absent, " is missing").otherwise(F.concat(F.lit(" is not "), kinds[failing]))),
        )
        .when(F.col("event_type") == "", "event_type is empty")
        .when(F.year("created_at") <= 1, "created_at is the zero time")
    )
    return typed.select(*messages.columns, *CANONICAL_COLUMNS, error.alias("error"))


def valid_events(checked: DataFrame, with_place: bool = False) -> DataFrame:
    """Canonical rows. Order, where it matters, is (`partition`, `offset`), kept with `with_place`."""
    extra = PLACE_COLUMNS if with_place else []
    return checked.filter(F.col("error").isNull()).select(*CANONICAL_COLUMNS, *extra)


def poison_messages(checked: DataFrame) -> DataFrame:
    """Dead letters: key and value untouched, the reason beside them."""
    return checked.filter(F.col("error").isNotNull()).select(
        "key",
        "value",
        "error",
        F.lit(POISON_ERROR_TYPE).alias("error_type"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
    )


def validate_canonical(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, poison). One bad message never fails the batch."""
    checked = check_messages(messages)
    return valid_events(checked), poison_messages(checked)
