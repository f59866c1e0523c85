"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``; ``n_chars`` follows the text.

1. ``quality`` drops documents that the classifier rejects.
2. ``line_dedup`` deletes repeated runs of two lines or more, and repeated single
   lines of 50 words or more, but for their first copy; documents without any
   text left are copies and go.  A document that had no text stays.
3. ``near_duplicates`` keeps the smallest doc_id of each group of linked
   documents (five-word shingles, similarity 0.8 or more).
4. ``decontamination`` drops documents that share a window with the benchmark.
5. ``tokens`` encodes what is left and decodes it again.

Rows without a doc_id belong to no group and pass stage 3; of rows that share
the doc_id that a group keeps, all stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import decontam, line_dedup, ngram_join, quality, queries, sentencepiece_table, sparkops

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.quality_scores(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their first copies of repeated line runs; those of which nothing is left go."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS), min_words=line_dedup.PASSAGE)
    kept = done.filter("n_kept > 0 or n_lines = 0")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    groups = ngram_join.ngram_jaccard_join(docs, n=5, percent=80)
    gone = sparkops.checkpoint(groups.filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    found = decontam.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return sentencepiece_table.op10_sentencepiece(docs, queries.tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: No SQL expresses the classifier, the component search or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages, Parquet in the shared folder."""
    base = f"{sparkops.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs
