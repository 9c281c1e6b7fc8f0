import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

import corpus_pipeline
from tidemark.llm import jaccard, pieces
from tidemark.llm.memory import _trim
from tidemark.llm.words_cache import frugal, release_caches
from tidemark.session import BATCH_BYTES, bound_batches

BATCH = pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])


def held():
    """MB of this process without mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists() or _trim() is None, reason="needs Linux with glibc")
@pytest.mark.parametrize("release", [release_caches, lambda: list(frugal(lambda batches: batches)(iter([BATCH])))])
def test_freed_memory_goes_back_to_the_system(release):
    release_caches()
    before = held()
    many = [np.ones(12_000) for _ in range(1000)]  # too small for mappings of their own
    last = many[-1]  # keeps the heap from shrinking by itself
    assert held() > before + 60
    del many
    release()
    assert held() < before + 20 and last[0] == 1


def test_released_models_are_built_again():
    model = pieces.read_model(path(corpus_pipeline.MODEL))
    texts = ["a few plain words", "x  y", ""]
    first = pieces._encoded(texts, model, True).to_pylist()
    assert pieces._backend.cache_info().currsize and pieces._original.cache_info().currsize
    release_caches()
    assert not pieces._backend.cache_info().currsize and not pieces._original.cache_info().currsize
    assert pieces._encoded(texts, model, True).to_pylist() == first


def test_sentencepiece_is_asked_for_few_ids_at_a_time(monkeypatch):
    model = pieces.read_model(path(corpus_pipeline.MODEL))
    texts = ["", "one two three", "", "four " * 50, "five", "", "six seven eight nine", "ten  eleven", ""]
    wanted = pieces._encoded(texts, model, True).to_pylist()
    asked, own = [], pieces._original(model)

    class Recorded:
        def encode(self, some, num_threads):
            found = own.encode(some, num_threads=num_threads)
            asked.append([len(ids) for ids in found])
            if "five" in some:  # one id differs, one text has one id more
                found[some.index("five")][0] += 1
            if "ten  eleven" in some:
                found[some.index("ten  eleven")].append(5)
            return found

    monkeypatch.setattr(pieces, "_original", lambda model: Recorded())
    monkeypatch.setattr(pieces, "MOST_COMPARED", 8)
    found = pieces._encoded(texts, model, True).to_pylist()
    assert len(asked) > 1 and all(sum(run) <= 8 or sum(n > 0 for n in run) == 1 for run in asked)
    assert sum(map(len, asked)) == len(texts)
    assert [r["ids"] for r in found] == [r["ids"] for r in wanted]
    assert [t for t, r in zip(texts, found, strict=True) if not r["parity"]] == ["five", "ten  eleven"]


def test_sketches_are_taken_without_an_index_of_their_bytes():
    draw = np.random.default_rng(3)
    column = pa.array([draw.bytes(256 if k % 2 else 32) for k in range(20_000)], pa.binary()).slice(100)
    rows = np.flatnonzero(np.arange(len(column)) % 2)
    tracemalloc.start()
    found = jaccard._rows_of(column, rows, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (len(rows), 256)
    assert [found[k].tobytes() for k in range(50)] == [column[int(r)].as_py() for r in rows[:50]]
    assert peak < 2 * found.nbytes


def test_the_search_begins_without_python_rows(spark):
    texts = spark.range(3).selectExpr("id AS cid", "concat('some words of text ', id) AS text")
    search = jaccard._Search(spark, texts, 4, 85)
    for frame in (search.tested, search.labels):
        assert "ExistingRDD" not in frame._jdf.queryExecution().toString() and frame.count() == 0


def test_batches_of_long_texts_are_bounded(spark):
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 40000) AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    try:
        corpus_pipeline.quality_rules(spark, docs, "")
        sizes = [r.n for r in docs.select("text").mapInArrow(count, "n BIGINT").collect()]
        assert sum(sizes) > 12_000_000 and max(sizes) < 5_000_000
        spark.conf.set(BATCH_BYTES, "1m")
        bound_batches(spark)
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES)
