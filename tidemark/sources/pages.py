"""Live pages: one JSON array of raw events per file."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import CORRUPT, RAW

# --- fixed values of the page format ---
MAX_PAGE_BYTES = 4 * 1024 * 1024
# --- end of fixed values ---

_ELEMENTS = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("payload", T.StringType())])
)
_BLANK = frozenset(" \t\r\n")
_BLANKS = re.compile(r"[ \t\r\n]*")


def _skip_blank(text: str, at: int) -> int:
    return _BLANKS.match(text, at).end() if text[at : at + 1] in _BLANK else at


def _element(
    text: str, at: int, decode: Callable[[str, int], tuple[object, int]] | None = None
) -> tuple[int, str | None]:
    """End of the element at `at` and the source text of its member `payload`; no JSON function keeps that
    byte for byte. Every member is decoded once."""
    decode = decode or json.JSONDecoder().raw_decode
    if text[at : at + 1] != "{":
        return decode(text, at)[1], None
    found, at = None, _skip_blank(text, at + 1)
    if text[at : at + 1] == "}":
        return at + 1, None
    while True:
        if text[at : at + 1] != '"':
            raise ValueError(f"no member name at character {at}")
        name, at = scanstring(text, at + 1)
        at = _skip_blank(text, at)
        if text[at : at + 1] != ":":
            raise ValueError(f"no value at character {at}")
        begin = _skip_blank(text, at + 1)
        _, at = decode(text, begin)
        if name == "payload":
            found = text[begin:at]
        at = _skip_blank(text, at)
        mark = text[at : at + 1]
        if mark == "}":
            return at + 1, None if found == "null" else found
        if mark != ",":
            raise ValueError(f"object breaks off at character {at}")
        at = _skip_blank(text, at + 1)


def split_page(text: str) -> list[tuple[str, str | None]]:
    """(element, payload) source texts of a page; ValueError if the page is not one JSON array."""
    decode = json.JSONDecoder().raw_decode  # building one costs more than reading a member
    at = _skip_blank(text, 0)
    if text[at : at + 1] != "[":
        raise ValueError("page is not a JSON array")
    out, at = [], _skip_blank(text, at + 1)
    if text[at : at + 1] == "]":
        at += 1
    else:
        while True:
            end, payload = _element(text, at, decode)
            out.append((text[at:end], payload))
            at = _skip_blank(text, end)
            mark = text[at : at + 1]
            if mark not in (",", "]"):
                raise ValueError(f"page breaks off at character {at}")
            at += 1
            if mark == "]":
                break
            at = _skip_blank(text, at)
    if _skip_blank(text, at) != len(text):
        raise ValueError("text after the JSON array")
    return out


def read_event_pages(spark: SparkSession, path: str | list[str], on_bad_page: str = "fail") -> DataFrame:
    """Raw events of all pages. A bad element becomes a reject row, its neighbours stay.

    `on_bad_page`: 'fail' raises on a page that is no JSON array or exceeds the size limit, 'reject'
    turns such a page into one reject row; of an oversized page that row holds the path, its content is
    never read. Pages are small and bounded, so one Arrow batch helper cuts them; everything after that
    is columnar.
    """
    if on_bad_page not in ("fail", "reject"):
        raise ValueError("on_bad_page must be 'fail' or 'reject'")
    strict = on_bad_page == "fail"

    @F.arrow_udf(_ELEMENTS)
    def elements(pages: pa.Array) -> pa.Array:
        starts, texts, payloads = [0], [], []
        for text in pages.to_pylist():
            try:
                found = split_page(text)
            except (ValueError, RecursionError):
                if strict:
                    raise
                found = [(None, text)]
            texts.extend([t for t, _ in found])
            payloads.extend([p for _, p in found])
            starts.append(len(texts))
        rows = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(payloads, pa.string())], ["text", "payload"])
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows)

    files = spark.read.format("binaryFile").load(path)
    too_long = F.concat(F.lit(f"page exceeds {MAX_PAGE_BYTES} bytes: "), F.col("path"))
    small = files.filter(F.col("length") <= MAX_PAGE_BYTES).select(elements(F.col("content").cast("string")).alias("es"))
    # The reader takes the length from the listing; this branch needs no content and reads none.
    large = files.filter(F.col("length") > MAX_PAGE_BYTES).select(
        F.array(
            F.struct(
                F.lit(None).cast("string").alias("text"),
                (F.raise_error(too_long).cast("string") if strict else too_long).alias("payload"),
            )
        ).alias("es")
    )
    cut = small.unionByName(large).select(F.explode("es").alias("e"))
    parsed = cut.select(
        F.from_json("e.text", RAW, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"),
        "e.text",
        "e.payload",
    )
    whole_page_bad = F.col("text").isNull()
    return parsed.select(
        *[F.col(f"r.{n}").alias(n) for n in RAW.fieldNames() if n not in ("payload", CORRUPT)],
        F.when(~whole_page_bad, F.col("payload")).alias("payload"),
        F.when(whole_page_bad, F.col("payload")).otherwise(F.col(f"r.{CORRUPT}")).alias(CORRUPT),
    )
