"""Threshold-scaled sketches against plain sets of shingles, and the edits against plain strings."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from llm_helpers import SF
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n=5):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def some_text(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sketch(text, **how):
    return fp.sketches(pa.array([text]), **how)[0]


def followed(rows):
    """(id, own text, edited text, next text) by the contract, rows sorted as documented."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1].encode()))
    for place, (key, text) in enumerate(rows):
        after = rows[(place + 1) % len(rows)][1]
        half = len(text) // 2
        yield key, text, text[: len(text) - half] + after[:half], after


def expected(rows):
    texts = list(followed(rows))
    for key, text, edited, after in texts:
        own, changed, other = (sketch(t) for t in (text, edited, after))
        yield (
            key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.to_text(own), fp.to_text(changed),
            fp.likeness(own, changed), fp.likeness(own, other),
        )


def test_sketch_is_every_hash_below_the_cut():
    text = some_text(random.Random(1), 3000)
    every = sketch(text, scale=1)
    assert every[0] == fp.COMPLETE and len(every[1]) == len(shingles(text))
    cut = fp.COMPLETE // fp.SCALE
    mark, kept = sketch(text)
    assert mark >= cut and kept.tolist() == [h for h in every[1].tolist() if h < cut]
    assert abs(len(kept) - len(every[1]) / fp.SCALE) < 5 * (len(every[1]) / fp.SCALE) ** 0.5


def test_few_shingles_keep_the_smallest_hashes():
    text = some_text(random.Random(2), 40)
    every = sketch(text, scale=1)[1].tolist()
    mark, kept = sketch(text)
    assert kept.tolist() == every[: fp.LEAST] and mark == every[fp.LEAST]
    short = some_text(random.Random(3), 12)
    assert sketch(short)[0] == fp.COMPLETE and len(sketch(short)[1]) == len(shingles(short)) == 8


def test_containment_of_very_unequal_texts():
    rng = random.Random(4)
    long = some_text(rng, 20_000, 10**6)
    part = " ".join(long.split()[5000:6000]) + " " + some_text(rng, 1000, 10**6)
    assert abs(fp.likeness(sketch(part), sketch(long)) - 0.5) < 0.1
    assert fp.likeness(sketch(some_text(rng, 1000, 10**6)), sketch(long)) == 0


def test_merged_sketch_is_the_sketch_of_both():
    rng = random.Random(5)
    a, b = some_text(rng, 900), some_text(rng, 30)
    mark, hashes = fp.merge(sketch(a), sketch(b))
    both = set(sketch(a, scale=1)[1].tolist()) | set(sketch(b, scale=1)[1].tolist())
    assert hashes.tolist() == sorted(h for h in both if h < mark)


def test_letters_case_and_bytes():
    assert sketch("The QUICK brown fox jumps")[1].tolist() == sketch(" the quick\nbrown\tfox  jumps ")[1].tolist()
    assert sketch("É b c d e")[1].tolist() != sketch("é b c d e")[1].tolist()
    assert fp.to_text(sketch("")) == fp.to_text(sketch(" \n")) == "f" * 16
    assert fp.likeness(sketch(""), sketch("")) == 1.0 and fp.likeness(sketch(""), sketch("a")) == 0.0
    assert fp.likeness(sketch("a b"), sketch("a b")) == 1.0 and fp.likeness(sketch("a b"), sketch("b a")) == 0.0
    for text in (None, "a", some_text(random.Random(6), 50)):
        found = fp.sketches(pa.array([text], pa.string()))[0]
        back = fp.from_text(fp.to_text(found))
        assert back[0] == found[0] and back[1].tolist() == found[1].tolist()


@pytest.mark.parametrize("partitions", [1, 7])
def test_edits_follow_the_order_of_ids(spark, partitions):
    rng = random.Random(7)
    rows = [(i * 3 % 101, some_text(rng, rng.randrange(120), 60)) for i in range(101)]
    rows += [(200, None), (201, ""), (202, "é" * 5), (203, "x"), (None, "no id " * 30), (204, some_text(rng, 30_000))]
    rows += [(50, rows[0][1])] * 3 + [(51, "tie a"), (51, "tie b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("id", F.lit("x"))
    frame = frame.withColumn("border", F.lit(True)).repartition(5)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        ours = [tuple(r) for r in fp.compare_with_next(frame).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sorted(ours, key=repr) == sorted(expected(rows), key=repr)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, some_text(rng, rng.randrange(1, 80))) for i in range(60)]
    monkeypatch.setattr(fp, "BLOCK", 300)
    schema = pa.schema([("range", pa.int64()), ("border", pa.bool_()), ("id", pa.int64()), ("text", pa.string())])
    dealt = list(fp._dealt([0, 13, 40], False, schema)([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "text"])]))
    table = pa.Table.from_batches(dealt)
    assert table.num_rows == 63 and table.filter(table["border"])["id"].to_pylist() == [0, 13, 40]
    assert table.filter(table["border"])["range"].to_pylist() == [2, 0, 1]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in fp.compare_with_next(frame).collect()) == sorted(expected(rows))


def test_one_row_empty_table_and_text_ids(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert [tuple(r) for r in fp.compare_with_next(one).collect()] == list(expected([(5, "abcd")]))
    assert fp.compare_with_next(one.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "abcd"), ("a", "xy"), ("é", "q")], "k string, t string")
    found = {r.k: r.edited_sha256 for r in fp.compare_with_next(named, id="k", text="t").collect()}
    assert found == {k: hashlib.sha256(e.encode()).hexdigest() for k, e in (("a", "xa"), ("b", "abq"), ("é", "q"))}


def test_columns_and_groups(spark):
    rng = random.Random(9)
    texts = [some_text(rng, 400, 10**6) for _ in range(6)]
    rows = [(i, t, "left" if i < 4 else None, "kept") for i, t in enumerate(texts)] + [(9, None, "empty", "kept")]
    marked = fp.with_fingerprint(spark.createDataFrame(rows, "id long, text string, part string, fingerprint string"))
    assert marked.columns == ["id", "text", "part", "fingerprint"]
    merged = {r.part: fp.from_text(r.fingerprint) for r in fp.merged_fingerprints(marked, "part", scale=16).collect()}
    for part, members in (("left", texts[:4]), (None, texts[4:])):
        every = set().union(*(sketch(t, scale=1)[1].tolist() for t in members))
        mark, hashes = merged[part]
        assert mark == fp.COMPLETE // 16 and hashes.tolist() == sorted(h for h in every if h < mark)
    assert len(merged["empty"][1]) == 0
    near = marked.select(fp.containment(F.col("fingerprint"), F.col("fingerprint")).alias("n")).collect()
    assert [r.n for r in near] == [1.0] * 7
    assert marked.select(fp.containment(F.col("fingerprint"), F.lit(None).cast("string")).alias("n")).first().n is None


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    ours = [tuple(r) for r in QUERIES["op11_scaled_sketch"](spark, SF).collect()]
    assert sorted(ours) == sorted(expected(rows))
    exact = []
    for _, text, edited, _ in followed(rows):
        a, b = shingles(text), shingles(edited)
        exact.append(len(a & b) / min(len(a), len(b)) if a and b else float(a == b))
    errors = [abs(r[5] - e) for r, e in zip(sorted(ours), exact)]
    # A share of LEAST hashes has a standard deviation of at most 0.5 / sqrt(LEAST), its mean error is 0.8 of that.
    assert sum(errors) / len(errors) < 0.8 * 0.5 / fp.LEAST**0.5
