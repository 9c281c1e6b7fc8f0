"""A quality classifier by co-training of two views.

The content view sees the words of a text and their shapes, the page view its metadata: source, language and layout.
Each view is a naive Bayes model over hashed features, so a model is a table of counts that Spark sums over any number
of documents. Both start from labelled documents. In every round each view scores all documents; where one is confident,
its verdict becomes a pseudo-label for the other, and both are counted anew. At the end the views are calibrated on
labelled documents that neither has learned from, and combined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import unused
from tidemark.llm.text import buffers_of, lines_of, mix, slices, span_hashes, words_of
from tidemark.llm.memory import give_back
from tidemark.llm.words_cache import frugal, release_caches

# At most this many labelled documents (those with the smallest seeded hash of their id) are used for fitting. The ids
# are known to every task, and their texts are the only ones read in the labelled passes.
MOST_LABELLED = 20_000
CALIBRATION = 4  # one labelled document in so many is kept for calibration
ROUNDS = 2
CONFIDENT = 0.98
KEEP_FROM = 0.5
SEED = 7
SLICE = 1 << 19  # bytes of text whose features are held at a time

WORD_BUCKETS = 1 << 16
SHAPES = 1 << 12
CONTENT = WORD_BUCKETS + SHAPES
FIELDS = ("size", "lines", "line length", "capitals", "digits", "signs", "non-ascii", "word length", "repeated lines", "distinct words")
PAGE = (len(FIELDS) + 2) * 256

_KIND = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 sign, 4 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _bins(share: np.ndarray, steps: int) -> np.ndarray:
    return np.minimum((share * steps).astype(np.int64), 255)


def _log_bins(value: np.ndarray) -> np.ndarray:
    return np.minimum((2 * np.log2(1 + value)).astype(np.int64), 255)


def _part(numerator: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    return np.divide(numerator, denominator, out=np.zeros(len(denominator)), where=denominator > 0)


@dataclass
class Features:
    """Features of many texts as pairs (text number, bucket), per view."""

    count: int
    content: tuple[np.ndarray, np.ndarray]
    page: tuple[np.ndarray, np.ndarray]


def features_of(text: pa.Array, attributes: list[pa.Array]) -> Features:
    data, offsets = buffers_of(text)
    count = len(text)
    words = words_of(data, offsets, lower=True)
    n_words = np.bincount(words.text, minlength=count)
    shape = _KIND[data[words.start]].astype(np.int64) * 256 + data[words.end - 1] if len(words) else np.zeros(0, np.int64)
    content = (
        np.concatenate([words.text, words.text]),
        np.concatenate([(words.hash % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS + shape]),
    )
    sizes = np.diff(offsets)

    def of_kind(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(upto[offsets])

    kind = _KIND[data]
    letters = of_kind(kind <= 1)
    lines = lines_of(data, offsets)
    n_lines = np.bincount(lines.text, minlength=count)
    keys = np.unique(np.stack([lines.text.astype(np.uint64), lines.hash]), axis=1) if len(lines) else np.zeros((2, 0), np.uint64)
    different = np.bincount(keys[0].astype(np.int64), minlength=count)
    seen = np.unique(words.hash ^ mix(words.text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    distinct = np.bincount(words.text[seen], minlength=count)
    fields = [
        _log_bins(sizes), _log_bins(n_lines), _log_bins(_part(sizes, n_lines)), _bins(_part(of_kind(kind == 1), letters), 32),
        _bins(_part(of_kind(kind == 2), sizes), 64), _bins(_part(of_kind((kind == 3) & ~_BLANK[data]), sizes), 64),
        _bins(_part(of_kind(kind == 4), sizes), 32), _log_bins(_part(np.bincount(words.text, words.chars, count), n_words)),
        _bins(1 - _part(different, n_lines), 16), _bins(_part(distinct, n_words), 32),
    ]
    for values in attributes[:2]:
        raw = pc.fill_null(values.cast(pa.string()), "\0")
        spans = buffers_of(raw)
        hashed = _hash_rows(*spans)
        fields.append((hashed % np.uint64(256)).astype(np.int64))
    page = (
        np.tile(np.arange(count), len(fields)),
        np.concatenate([256 * k + f for k, f in enumerate(fields)]) if count else np.zeros(0, np.int64),
    )
    return Features(count, content, page)


def _hash_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return span_hashes(data, offsets[:-1], offsets[1:])


@dataclass
class View:
    """Log-odds per bucket, and the calibration of their mean over a text's features."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, pairs: tuple[np.ndarray, np.ndarray], count: int) -> np.ndarray:
        text, bucket = pairs
        return _part(np.bincount(text, self.weights[bucket], count), np.bincount(text, minlength=count))

    def logit(self, pairs: tuple[np.ndarray, np.ndarray], count: int) -> np.ndarray:
        return self.slope * self.raw(pairs, count) + self.shift


@dataclass
class Model:
    content: View
    page: View
    mixing: np.ndarray  # of the two logits and a constant

    def score(self, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        content = self.content.logit(features.content, features.count)
        page = self.page.logit(features.page, features.count)
        both = np.stack([content, page, np.ones(features.count)])
        return _chance(content), _chance(page), _chance(self.mixing @ both)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _logistic(columns: np.ndarray, target: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column is the constant."""
    weights = np.zeros(columns.shape[1])
    keep = ridge * np.diag([*[1.0] * (columns.shape[1] - 1), 1e-6 / ridge])
    for _ in range(50):
        p = _chance(columns @ weights)
        slope = columns.T @ (target - p) - keep @ weights
        bend = (columns * (p * (1 - p))[:, None]).T @ columns + keep + 1e-9 * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _weights(counts: np.ndarray) -> np.ndarray:
    """Naive Bayes log-odds of counts[class, bucket], with add-one smoothing over the buckets of a view."""
    smooth = counts + 1.0
    return np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())


# Spark --------------------------------------------------------------------------------------------


class Labels:
    """Labelled ids, sorted, for look-ups in tasks."""

    def __init__(self, ids: np.ndarray, good: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.good = ids[order], good[order]

    def of(self, ids: pa.Array) -> np.ndarray:
        """1, 0 or -1 (none) per row."""
        values = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        if not len(self.ids):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.ids, values), len(self.ids) - 1)
        found = (self.ids[at] == values) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
        return np.where(found, self.good[at], -1)


def sample_labels(labels: DataFrame, doc_id: str, label: str, most: int) -> tuple[Labels, DataFrame]:
    """At most `most` labelled ids; an id with contradicting labels counts as bad."""
    clean = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).cast("bigint").alias("__id"))
        .agg((F.min(label) > 0).cast("int").alias("good"))
        .orderBy(F.xxhash64("__id", F.lit(SEED)), "__id")
        .limit(most)
    )
    table = clean.toArrow()
    found = Labels(table.column("__id").to_numpy().astype(np.int64), table.column("good").to_numpy().astype(np.int64))
    return found, labels.sparkSession.createDataFrame(table.select(["__id"]))


def _in_calibration(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(CALIBRATION) == 0


def _columns(docs: DataFrame, doc_id: str, text: str, attributes: tuple[str, ...]) -> DataFrame:
    there = [F.col(a).cast("string").alias(f"a{k}") if a in docs.columns else F.lit("").alias(f"a{k}") for k, a in enumerate(attributes)]
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), *there)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Features]]:
    for batch in batches:
        at = 0
        for part in slices(batch.column(1), SLICE):
            yield batch.column(0).slice(at, len(part)), features_of(part, [c.slice(at, len(part)) for c in batch.columns[2:]])
            at += len(part)


def _sums(rows: DataFrame, counted) -> list[np.ndarray]:
    """Sum the counts that `counted(id column, features)` gives per view as (class per text), over all rows.

    Each task adds up its own table and sends its filled cells once; the sums come back as one table of fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((2, CONTENT), np.int64), np.zeros((2, PAGE), np.int64)]
        for ids, features in _parts(batches):
            for table, pairs, group in zip(tables, (features.content, features.page), counted(ids, features), strict=True):
                text, bucket = pairs
                used = group[text] >= 0
                size = table.shape[1]
                cells = np.unique(text[used] * (2 * size) + group[text[used]] * size + bucket[used]) % (2 * size)
                table += np.bincount(cells, minlength=2 * size).reshape(2, size)
        flat = np.concatenate([t.reshape(-1) for t in tables])
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell])], names=["cell", "n"])

    summed = rows.mapInArrow(frugal(count), "cell BIGINT, n BIGINT").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(2 * (CONTENT + PAGE))
    flat[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    return [flat[: 2 * CONTENT].reshape(2, CONTENT), flat[2 * CONTENT :].reshape(2, PAGE)]


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    attributes: tuple[str, str] = ("source", "lang"), most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS,
) -> Model:
    """Co-train on `docs`. Without labels of both classes every document gets the chance 1."""
    known, ids = sample_labels(labels, doc_id, label, most_labelled)
    rows = _columns(docs, doc_id, text, attributes)
    if len(set(known.good.tolist())) < 2:
        flat = View(np.zeros(CONTENT), 0.0, 40.0), View(np.zeros(PAGE), 0.0, 40.0)
        return Model(*flat, np.array([1.0, 1.0, 0.0]))
    # The ids are at most `most_labelled`, so their broadcast is bounded.
    labelled = rows.join(F.broadcast(ids), F.col("id") == F.col("__id"), "left_semi")

    def taught(column: pa.Array, features: Features) -> tuple[np.ndarray, np.ndarray]:
        good = known.of(column)
        learned = np.where(_in_calibration(pc.fill_null(column, 0).to_numpy(zero_copy_only=False)), -1, good)
        return learned, learned

    from_labels = _sums(labelled, taught)
    model = _calibrated(labelled, known, [_weights(c) for c in from_labels])
    for _ in range(rounds):
        now = model

        def exchanged(column: pa.Array, features: Features, now: Model = now) -> tuple[np.ndarray, np.ndarray]:
            by_content, by_page, _ = now.score(features)
            free = known.of(column) < 0

            def verdict(chance: np.ndarray) -> np.ndarray:
                return np.where(free & (chance >= CONFIDENT), 1, np.where(free & (chance <= 1 - CONFIDENT), 0, -1))

            return verdict(by_page), verdict(by_content)  # the page view teaches the content view, and the reverse

        pseudo = _sums(rows, exchanged)
        # Pseudo-labels weigh no more than the labels of their class, however many documents there are.
        shares = [
            np.minimum(1.0, own.sum(axis=1, keepdims=True) / np.maximum(more.sum(axis=1, keepdims=True), 1))
            for own, more in zip(from_labels, pseudo, strict=True)
        ]
        joined = [own + share * more for own, share, more in zip(from_labels, shares, pseudo, strict=True)]
        model = _calibrated(labelled, known, [_weights(c) for c in joined])
    return model


def _calibrated(labelled: DataFrame, known: Labels, weights: list[np.ndarray]) -> Model:
    """Platt scaling of both views and their combination, on the labelled documents kept for it (all if one class is missing)."""
    views = [View(w) for w in weights]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, features in _parts(batches):
            raw = [v.raw(p, features.count) for v, p in zip(views, (features.content, features.page), strict=True)]
            keep = _in_calibration(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(known.of(ids)), pa.array(keep), *map(pa.array, raw)], names=["id", "good", "fresh", "content", "page"]
            )

    table = labelled.mapInArrow(frugal(score), "id BIGINT, good BIGINT, fresh BOOLEAN, content DOUBLE, page DOUBLE").toArrow().sort_by("id")
    good = table.column("good").to_numpy().astype(float)
    fresh = table.column("fresh").to_numpy().astype(bool)
    raw = np.stack([table.column("content").to_numpy(), table.column("page").to_numpy()])
    if len(set(good[fresh].tolist())) == 2:
        good, raw = good[fresh], raw[:, fresh]
    if len(set(good.tolist())) < 2:
        return Model(*[View(w, 0.0, 40.0) for w in weights], np.array([1.0, 1.0, 0.0]))
    one = np.ones(len(good))
    logits = []
    for view, values in zip(views, raw, strict=True):
        spread = values.std() or 1.0
        slope, shift = _logistic(np.stack([values / spread, one], axis=1), good)
        view.slope, view.shift = max(slope, 0.0) / spread, shift
        logits.append(view.slope * values + view.shift)
    return Model(*views, _logistic(np.stack([*logits, one], axis=1), good))


RESULT = "content_score DOUBLE, page_score DOUBLE, score DOUBLE, kept BOOLEAN"
_ARROW = [("content_score", pa.float64()), ("page_score", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())]


def with_quality(
    docs: DataFrame, model: Model, text: str = "text", attributes: tuple[str, str] = ("source", "lang"),
    out: str = "quality", keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Add a struct with each view's calibrated chance, their combination and the verdict, for every row.

    A null text counts as empty; a null or missing attribute is a value of its own. Texts are read whole. Repeated rows
    are scored alike, other columns stay, a column that has the name `out` is replaced; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size

    def score(texts: pa.Array, *values: pa.Array) -> pa.Array:
        release_caches()
        found: list[tuple[np.ndarray, ...]] = []
        at = 0
        for part in slices(texts, SLICE):
            features = features_of(part, [v.slice(at, len(part)) for v in values])
            found.append(held.value.score(features))
            at += len(part)
            del features
        give_back()
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3)]
        arrays = [pa.array(c, pa.float64()) for c in columns] + [pa.array(columns[2] >= keep_from)]
        return pa.StructArray.from_arrays(arrays, names=[n for n, _ in _ARROW])

    given = [F.col(f"`{a}`").cast("string") if a in docs.columns else F.lit("") for a in attributes]
    return docs.withColumn(out, F.arrow_udf(score, RESULT)(F.col(text), *given))


def keep_good(docs: DataFrame, model: Model, text: str = "text", **options) -> DataFrame:
    """The rows that the classifier keeps, with the columns they came with."""
    (out,) = unused(docs, "quality")
    judged = with_quality(docs, model, text, out=out, **options)
    return judged.filter(F.col(f"{out}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
