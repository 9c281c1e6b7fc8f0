import os
import random

import pytest
from llm_helpers import SF
from test_jaccard import plain_set
from test_repetition import plain as repetition

import corpus_pipeline
from tidemark.llm.repetition import FEWEST_WORDS, MOST_DUPLICATE_CHARS, MOST_DUPLICATE_LINE_CHARS, MOST_DUPLICATE_LINES, MOST_TOP_CHARS

KIND = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def passes(text):
    p = repetition(text)
    if p["n_words"] < FEWEST_WORDS or 100 * p["n_repeat_words"] > 20 * p["n_words"]:
        return False
    shares = {"dup_line_share": MOST_DUPLICATE_LINES, "dup_line_char_share": MOST_DUPLICATE_LINE_CHARS}
    shares |= {f"top_{n}gram_char_share": v for n, v in MOST_TOP_CHARS.items()}
    shares |= {f"dup_{n}gram_char_share": v for n, v in MOST_DUPLICATE_CHARS.items()}
    return all(p[k] <= v for k, v in shares.items())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, near copies, junk and odd rows, and labels for some of it."""
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(160):
        junk = i % 5 == 4
        words = draw.choices([f"word{k}" for k in range(900)], k=draw.randrange(15, 120))
        if junk:
            words = [w.upper() + "###!!" for w in words]
        elif i % 7 == 3 and rows:
            words = rows[-1][1].split(" ")
            words[5:6] = []
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 11 else None, len(words)))
        if i % 2:
            labels.append((i, int(not junk), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, "a b c " * 60, "en", "s1", 1), (None, rows[0][1] + " more", "en", "s0", 3)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, KIND).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage_on_what_the_one_before_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, folder)
        rows = frame.collect()
        assert frame.columns == columns or name == "sentencepiece"
        results.append(rows)
        docs = spark.createDataFrame(rows, frame.schema)
    raw, ruled, good, single, mixed, encoded = results

    key = lambda r: (r.doc_id, r.text)
    assert {key(r) for r in ruled} == {key(r) for r in raw if passes(r.text)}
    assert all("###" not in r.text for r in good)
    clean = [r for r in ruled if "###" not in r.text]
    assert len(good) >= 0.95 * len(clean)
    sets = [plain_set(r.text, 5) for r in single]
    for i, a in enumerate(sets):
        assert not any(100 * len(a & b) >= 80 * len(a | b) for b in sets[:i])
    stayed = [plain_set(r.text, 5) for r in single]
    for r in good:  # whoever went had a link in its stage
        mine = plain_set(r.text, 5)
        if key(r) not in {key(s) for s in single}:
            others = [plain_set(o.text, 5) for o in good if key(o) != key(r)]
            assert any(100 * len(mine & b) >= 80 * len(mine | b) for b in others)
    total = sum(len(r.text.split()) for r in single)
    taken = sum(len(r.text.split()) for r in mixed)
    assert stayed and 1.5 * total - 120 <= taken <= 1.5 * total
    assert {key(r) for r in mixed} <= {key(r) for r in single}
    assert len(encoded) == len(mixed) and all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in encoded)


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, docs.collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
