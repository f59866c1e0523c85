"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fingerprint, line_dedup, ngram_join, pii, quality, rlz_dedup, sentencepiece_table, shard, spelling, suffix_dedup, token_alignment
from .oracle import ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op2_line_dedup(_read(spark, sf_dir, "documents"))


def op2_long_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two lines, and single lines of a passage's length; the twin of op2_line_dedup has only the former."""
    return line_dedup.op2_line_dedup(_read(spark, sf_dir, "documents"), min_words=line_dedup.PASSAGE)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op3_decontamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.op4_hilbert_shards(_read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5_pii(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op7_suffix_dedup(_read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op8_chat_format(_read(spark, sf_dir, "conversations"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op9_fingerprints(_read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.op10_sentencepiece(_read(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op11_spelling(_read(spark, sf_dir, "documents"))


def op12_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.op12_rlz_dedup(_read(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.op13_token_alignment(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_line_dedup": op2_line_dedup,
    "op2_long_line_dedup": op2_long_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_fingerprints": op9_fingerprints,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling": op11_spelling,
    "op12_rlz_dedup": op12_rlz_dedup,
    "op13_token_alignment": op13_token_alignment,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
