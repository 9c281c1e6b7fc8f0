"""From raw documents to token ids: five stages, each written to Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of `documents`; the last adds the ids. Arrow batches of the session are bounded in bytes, unless it sets a limit of its own.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.cotraining import fit, keep_good
from tidemark.llm.jaccard import keep_one_of_each
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.pieces import read_model, with_pieces
from tidemark.llm.repetition import keep_unrepetitive
from tidemark.session import bound_batches, work_dir

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is long enough and not made of repetitions."""
    bound_batches(spark)
    return keep_unrepetitive(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it learns from the labels and from the documents that came so far."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bound_batches(spark)
    return keep_one_of_each(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all, once or twice."""
    return mixed_documents(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, whose decoding is compared with the text."""
    bound_batches(spark)
    encoded = with_pieces(docs, read_model(tokenizer_path(MODEL)))
    return encoded.select(*docs.columns, "pieces.ids", "pieces.n_tokens", "pieces.round_trip", "pieces.parity")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_sources", mix_sources),
    ("sentencepiece", sentencepiece_ids),
]

# A trained classifier and a tokenizer have no SQL form; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; every result but the last is written to the shared work folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
