"""LM scoring by prediction by partial matching.

A text is its lower-case words with a blank between them and an end. Every byte, blank and end is a symbol, predicted from the
ORDER symbols before it, across word borders, down to none and at last evenly. A context that has seen n symbols of d
kinds gives a seen one c / (n + d) and keeps d / (n + d) for the escape to the next shorter context (method C), which leaves
out what the longer one has ruled out. `score` is the log10 probability of the whole text.

Cells (context and symbol) are counted in a distributed table, one for each order, made by adding up the longer one. Only
cells with a HOT_CELLS-th of all symbols are sent to every task; the others are joined. The counts of whole words, which the
smoothed base score needs, are kept the same way under 63-bit hashes of the words, with at most HEAVY sent to every task.
What a text still has to look up leaves its task as (row, key, number): words and cells in one narrow join, whose key is
a word's hash (negative) or a cell (not negative).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import LOWER, buffers_of, slices, words_of
from tidemark.session import work_dir

HEAVY = 1 << 20
ORDER = 4  # symbols in the longest context of a text
HOT_CELLS = 1 << 21
PIECE = 1 << 20
FOLDS, HELD_OUT = 5, 1
FLUSH = 1 << 20
BEGIN = 257  # digit of the text's begin in a context; digits 1 to 256 are bytes, 0 is nothing
SYMBOLS = 257  # 256 bytes and the end
STEP = 258
_LOWER = LOWER.tobytes()


def held_out(doc_id: str) -> Column:
    """True for documents that the model does not learn from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


# Contexts over the text -----------------------------------------------------------------------------


def text_cells(tokens: list[bytes]) -> Iterator[np.ndarray]:
    """Cells of all symbols of a text in pieces: ORDER digits of context, the nearest last, then the symbol."""
    text = np.frombuffer(b" ".join(tokens), np.uint8)
    digits = np.zeros(ORDER + len(text) + 1, np.uint16)
    digits[ORDER - 1] = BEGIN
    digits[ORDER:-1] = text
    digits[ORDER:-1] += 1
    digits[-1] = SYMBOLS
    for at in range(0, len(text) + 1, PIECE):
        part = digits[at : at + PIECE + ORDER].astype(np.int64)
        size = len(part) - ORDER
        cell = part[:size].copy()
        for k in range(1, ORDER):
            cell *= STEP
            cell += part[k : k + size]
        yield cell * SYMBOLS + part[ORDER:] - 1


class HotCells:
    """Code lengths (log10) of the most frequent cells."""

    def __init__(self, cell: np.ndarray, length: np.ndarray):
        order = np.argsort(cell)
        self.cell = np.append(cell[order], np.iinfo(np.int64).max)
        self.length = np.append(length[order], 0.0)

    def look(self, cells: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the code lengths of hot cells, and the cells that are not hot."""
        at = np.searchsorted(self.cell, cells)
        hot = self.cell[at] == cells
        return float(self.length[at[hot]].sum()), cells[~hot]


# Spark --------------------------------------------------------------------------------------------


def word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text of a column: text, key and number, and the number of words of each text."""
    words = words_of(*buffers_of(column), lower=True)
    key = words.hash.view(np.int64) | np.iinfo(np.int64).min
    order = np.lexsort((key, words.text))
    text, key = words.text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    return text[starts], key[starts], np.diff(np.append(starts, len(key))), np.bincount(words.text, minlength=len(column))


def word_counts(docs: DataFrame, text: str, learned: Column) -> DataFrame:
    """(key, n): how often each distinct word stands in the learned texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                key = words_of(*buffers_of(part), lower=True).hash.view(np.int64) | np.iinfo(np.int64).min
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    counted = docs.filter(learned).select(F.col(f"`{text}`")).mapInArrow(count, "key BIGINT, n BIGINT")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def cell_counts(docs: DataFrame, text: str, chosen: Column, hot: Broadcast | None = None) -> DataFrame:
    """(cell, n): how often each cell stands in the chosen texts, without those of a broadcast `HotCells`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for value in batch.column(0):
                for cells in text_cells(tokens_of(value.as_py())):
                    held.append(cells if hot is None else hot.value.look(cells)[1])
                    size += len(held[-1])
                    if size > PIECE:
                        yield _summed(held)
                        held, size = [], 0
        if held:
            yield _summed(held)

    return docs.filter(chosen).select(F.col(f"`{text}`")).mapInArrow(count, "cell BIGINT, n BIGINT").groupBy("cell").agg(F.sum("n").alias("n"))


def _summed(held: list[np.ndarray]) -> pa.RecordBatch:
    cell, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])


def _shorter(cell: str, order: int) -> Column:
    """The cell with the last `order` digits of its context."""
    return F.col(cell) % F.lit(STEP**order * SYMBOLS)


class CellTables:
    """Counts of the learned cells at every order, as Parquet tables."""

    def __init__(self, docs: DataFrame, text: str, learned: Column):
        spark = docs.sparkSession
        self.orders: list[DataFrame] = []
        longest = cell_counts(docs, text, learned)
        for order in range(ORDER, -1, -1):
            if self.orders:
                longest = self.orders[0].groupBy(_shorter("cell", order).alias("cell")).agg(F.sum("n").alias("n"))
            folder = work_dir(spark, f"cells-{order}")
            longest.write.parquet(folder)
            self.orders.insert(0, spark.read.schema("cell BIGINT, n BIGINT").parquet(folder))

    def contexts(self, order: int) -> DataFrame:
        """(context, total, kinds, below): occurrences, distinct symbols, and their occurrences in the next shorter context."""
        cells = self.orders[order].withColumn("below", F.lit(0).cast("bigint"))
        if order:
            less = self.orders[order - 1].select(F.col("cell").alias("less"), F.col("n").alias("below"))
            cells = self.orders[order].withColumn("less", _shorter("cell", order - 1)).join(less, "less")
        return cells.groupBy(F.expr(f"cell div {SYMBOLS}").alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("below").alias("below")
        )

    def seen(self) -> DataFrame:
        """(cell, n, length) of every learned cell of the longest context."""
        return (
            self.orders[ORDER]
            .withColumn("context", F.expr(f"cell div {SYMBOLS}"))
            .join(self.contexts(ORDER), "context")
            .select("cell", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("length"))
        )

    def unseen(self, cells: DataFrame) -> DataFrame:
        """(cell, length) of cells that were not learned, from the longest context down to an even choice."""
        # What a longer context has seen the shorter one has seen too: `kinds` and `below` of the longer one are ruled out.
        now = cells.select(
            "cell", F.lit(0.0).alias("length"), F.lit(True).alias("open"), F.lit(0).cast("bigint").alias("out"), F.lit(0).cast("bigint").alias("out_n")
        )
        for order in range(ORDER, -1, -1):
            count = self.orders[order].select(F.col("cell").alias("short"), F.col("n").alias("c"))
            now = (
                now.withColumn("short", _shorter("cell", order))
                .join(count, "short", "left")
                .withColumn("context", F.expr(f"short div {SYMBOLS}"))
                .join(self.contexts(order), "context", "left")
            )
            left = F.col("kinds") - F.col("out")
            room = F.col("total") - F.col("out_n") + left
            now = now.select(
                "cell",
                (F.col("length") + F.when(F.col("open") & (left > 0), F.log10(F.coalesce("c", left) / room)).otherwise(0.0)).alias("length"),
                (F.col("open") & F.col("c").isNull()).alias("open"),
                F.coalesce("kinds", F.lit(0).cast("bigint")).alias("out"),
                F.coalesce("below", F.lit(0).cast("bigint")).alias("out_n"),
            )
        even = F.when(F.col("open"), F.log10(F.lit(SYMBOLS) - F.col("out"))).otherwise(0.0)
        return now.select("cell", (F.col("length") - even).alias("length"))


_ABOUT = "<?qqdd"  # held_out, n_tokens, n_known, base and score as far as the task knows them
ROW_KEY = 1 << 62  # keys from here on are those of rows themselves; they find nothing in the join and spread these rows


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score.

    The scores are log10 probabilities: of the words by smoothed counts, and of the text by partial matching.
    The model learns from the documents that are not held out. A null text is empty: its only token is the end. Repeated
    rows are scored each. Without any training document N and V are 0, the base is 0 a token and every symbol of a text is as
    likely as any other. An empty table gives no rows; columns other than the two play no part.
    """
    spark = docs.sparkSession
    learned = ~held_out(doc_id)
    folder = work_dir(spark, "words")
    word_counts(docs, text, learned).write.parquet(folder)
    counts = spark.read.schema("key BIGINT, n BIGINT").parquet(folder)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = docs.filter(learned).count()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    whole = math.log10(total + 0.5 * (distinct + 1))
    is_heavy = F.col("n") * HEAVY >= F.lit(max(total, 1))
    heavy = counts.filter(is_heavy).toArrow()  # at most HEAVY
    order = np.argsort(heavy.column("key").to_numpy())
    heavy_words = tuple(np.append(heavy.column(c).to_numpy()[order], -1) for c in ("key", "n"))

    cells = CellTables(docs, text, learned)
    folder = work_dir(spark, "cell-lengths")
    cells.seen().write.parquet(folder)
    lengths = spark.read.schema("cell BIGINT, n BIGINT, length DOUBLE").parquet(folder)
    symbols = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col("n") * HOT_CELLS >= F.lit(max(symbols, 1))
    found = lengths.filter(is_hot).select("cell", "length").toArrow()  # at most HOT_CELLS
    hot = spark.sparkContext.broadcast(HotCells(found.column("cell").to_numpy(), found.column("length").to_numpy()))
    model = spark.sparkContext.broadcast(heavy_words)
    new = cell_counts(docs, text, ~learned, hot).join(lengths, "cell", "left_anti")
    rare_cells = lengths.filter(~is_hot).select("cell", "length").unionByName(cells.unseen(new))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_key, heavy_n = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for part in slices(batch.column(0)):
                held, ids = batch.column(1).slice(at, len(part)).to_pylist(), batch.column(2).slice(at, len(part))
                at += len(part)
                number, key, n, size = word_keys(part)
                place = np.searchsorted(heavy_key[:-1], key)
                known = heavy_key[place] == key
                c = heavy_n[place[known]]
                n_known = np.bincount(number[known], n[known], len(part)).astype(np.int64) + (ends > 0)
                base = np.bincount(number[known], n[known] * np.log10(c + 0.5), len(part)) + math.log10(ends + 0.5)
                rows, keys, times = [row + number[~known]], [key[~known]], [n[~known]]
                about, waiting = [], len(rows[0])
                for k, value in enumerate(part.to_pylist()):
                    score = 0.0
                    for symbols_of in text_cells(tokens_of(value)):
                        length, other = hot.value.look(symbols_of)
                        score += length
                        if len(other):
                            cell, m = np.unique(other, return_counts=True)
                            rows.append(np.full(len(cell), row + k))
                            keys.append(cell)
                            times.append(m)
                            waiting += len(cell)
                    about.append(struct.pack(_ABOUT, held[k], int(size[k]) + 1, int(n_known[k]), float(base[k]), score))
                    if waiting > FLUSH:
                        yield _asked(rows, keys, times, ids.type)
                        rows, keys, times, waiting = [], [], [], 0
                if rows:
                    yield _asked(rows, keys, times, ids.type)
                own = np.arange(row, row + len(part))
                info = pa.StructArray.from_arrays([pa.array(about, pa.binary()), ids], names=["packed", "doc_id"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(own + ROW_KEY), pa.array(np.zeros(len(part), np.int64)), info],
                    names=["row", "key", "n", "about"],
                )
                row += len(part)

    id_field = docs.schema[doc_id].dataType.simpleString()
    looked = docs.select(F.col(f"`{text}`"), held_out(doc_id), F.col(f"`{doc_id}`")).mapInArrow(
        look, f"row BIGINT, key BIGINT, n BIGINT, about STRUCT<packed: BINARY, doc_id: {id_field}>"
    )
    keyed = counts.filter(~is_heavy).select("key", F.col("n").alias("c"), F.lit(None).cast("double").alias("length")).unionByName(
        rare_cells.select(F.col("cell").alias("key"), F.lit(None).cast("bigint").alias("c"), "length")
    )
    is_word = F.col("key") < 0
    found = F.when(is_word & F.col("c").isNotNull(), F.col("n")).otherwise(0)
    scored = looked.join(keyed, "key", "left").groupBy("row").agg(
        F.first("about", ignorenulls=True).alias("about"),  # one row of each has it
        F.sum(found).alias("known"),
        F.sum(F.when(is_word, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).otherwise(0.0)).alias("base"),
        F.sum(F.when(is_word, 0.0).otherwise(F.col("n") * F.coalesce("length", F.lit(0.0)))).alias("score"),
    )

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id, about, known, base, score = batch.columns
            parts = [struct.unpack(_ABOUT, a) for a in about.to_pylist()]
            held, n_tokens, n_known, own_base, own_score = zip(*parts, strict=True) if parts else ((),) * 5
            n = np.array(n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [id, pa.array(held, pa.bool_()), pa.array(n), pa.array(np.array(n_known, np.int64) + known.to_numpy()),
                 pa.array(np.full(len(n), total, np.int64)), pa.array(np.array(own_base) + base.to_numpy() - n * whole),
                 pa.array(np.array(own_score) + score.to_numpy())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return scored.select("about.doc_id", "about.packed", "known", "base", "score").mapInArrow(
        result,
        f"doc_id {id_field}, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE",
    )


def _asked(rows: list[np.ndarray], keys: list[np.ndarray], times: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
    row, key, n = (np.concatenate(c).astype(np.int64) for c in (rows, keys, times))
    none = pa.nulls(len(row), pa.struct([("packed", pa.binary()), ("doc_id", id_type)]))
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(key), pa.array(n), none], names=["row", "key", "n", "about"])
