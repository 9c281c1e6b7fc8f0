"""The named queries of this subpackage on the sample tables: (session, folder of Parquet tables) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.conversations import damage_and_repair
from tidemark.llm.cotraining import fit, with_quality
from tidemark.llm.embeddings import near_vectors
from tidemark.llm.filter_audit import audit_filters, text_failures
from tidemark.llm.fingerprints import compare_with_next
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.licenses import with_licenses
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pieces import read_model, with_pieces
from tidemark.llm.ppm import score_texts
from tidemark.llm.repetition import with_repetition
from tidemark.llm.token_files import library_encoder, read_token_files, write_token_files
from tidemark.llm.warc import archive_pages, read_archives
from tidemark.session import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model(tokenizer_path("piece_bpe_32k.model"))
    encoded = with_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return encoded.select("doc_id", *[f"pieces.{c}" for c in ("n_tokens", "ids_crc32", "round_trip", "parity", "ids")])


def op2_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op3_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archive_pages(_table(spark, sf_dir, "pages"), work_dir(spark, "archives"), least=0)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encode = library_encoder(file.read(), end_id=0)
    docs = _table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, work_dir(spark, "token-files"), encode, largest_id=50_256)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_repetition(_table(spark, sf_dir, "documents")).select("doc_id", "repetition.*")


def op6_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    return with_quality(docs, model).select("doc_id", "quality.*")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_licenses(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")],
        "license.detections",
    )


def op9_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    )


def op10_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return audit_filters(docs, text_failures(), "E", labels)


def op13_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_partial_matching": op2_partial_matching,
    "op3_zip_archives": op3_zip_archives,
    "op4_token_files": op4_token_files,
    "op5_repetition_coverage": op5_repetition_coverage,
    "op6_partition_join": op6_partition_join,
    "op7_cotraining": op7_cotraining,
    "op8_license_scan": op8_license_scan,
    "op9_weighted_fair_mix": op9_weighted_fair_mix,
    "op10_rotation_codes": op10_rotation_codes,
    "op11_scaled_sketch": op11_scaled_sketch,
    "op12_filter_audit": op12_filter_audit,
    "op13_run_length_repair": op13_run_length_repair,
}

SQL: dict[str, str] = {
    "op6_partition_join": sql.JACCARD,
    "op9_weighted_fair_mix": sql.MIX,
    "op10_rotation_codes": sql.NEAR_VECTORS,
    "op12_filter_audit": sql.FILTER_AUDIT,
}
