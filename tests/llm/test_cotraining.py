import os

import numpy as np
import pytest
from llm_helpers import SF
from pyspark.sql import functions as F

from tidemark.llm.cotraining import _logistic, fit, keep_good, sample_labels, with_quality

ROWS = [(1, "good words here", "a", "en", 3), (1, "good words here", "a", "en", 3), (None, None, None, None, 1), (2, "", "b", None, 0), (3, " \n\n", "", "", 0), (4, "x" * 400_000 + " !!\n" * 3000, "c", "fr", 1)]
KIND = "doc_id BIGINT, text STRING, source STRING, lang STRING, quality INT"


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known, _ = sample_labels(labels, "doc_id", "quality", 200)
    assert len(known.ids) == 200
    model = fit(docs, labels, most_labelled=200)
    judged = with_quality(docs, model, out="q").join(labels, "doc_id").select("doc_id", "q.*", "quality").toPandas()
    fresh = judged[~judged.doc_id.isin(known.ids)]
    good = fresh.quality > 0
    assert (fresh.kept == good).mean() >= 0.95 and fresh.kept[good].mean() >= 0.96 and (~fresh.kept[~good]).mean() >= 0.85
    assert keep_good(docs, model).columns == docs.columns
    again = with_quality(docs, fit(docs.repartition(5), labels, most_labelled=200), out="q")
    ours = {r.doc_id: r.score for r in judged.itertuples()}
    theirs = {r.doc_id: r.q.score for r in again.join(labels, "doc_id", "left_semi").collect()}
    assert theirs == pytest.approx(ours, abs=1e-9)


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame(ROWS, KIND)
    for labels in ([], [(1, 1), (None, 0), (2, None)], [(1, 1), (1, 0), (2, 1), (4, 0), (3, 0)]):
        model = fit(docs, spark.createDataFrame(labels, "doc_id BIGINT, quality INT"))
        rows = with_quality(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.quality.score <= 1 for r in rows)
        assert len({r.quality.score for r in rows if r.doc_id == 1}) == 1
        if not any(q == 0 for d, q in labels if d is not None):
            assert all(r.quality.kept for r in rows)
    assert with_quality(docs.limit(0), model).collect() == []
    bare = with_quality(docs.select("doc_id", "text"), model)
    assert bare.columns == ["doc_id", "text", "quality"] and bare.filter(F.col("quality.score").isNull()).count() == 0


def test_contradicting_labels_count_as_bad(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1)], "doc_id BIGINT, quality INT")
    known, _ = sample_labels(labels, "doc_id", "quality", 10)
    assert dict(zip(known.ids.tolist(), known.good.tolist())) == {1: 0, 2: 1}


def test_logistic_regression_finds_the_odds():
    draw = np.random.default_rng(0)
    x = draw.standard_normal(20_000)
    y = (draw.random(20_000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(float)
    assert _logistic(np.stack([x, np.ones(20_000)], axis=1), y) == pytest.approx([1.5, -0.5], abs=0.1)
