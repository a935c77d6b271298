"""Corpus preparation in stages; each stage's result is written and read again as the next one's documents.

All stages but the last return the columns of documents. doc_id names a document throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygraph.llm import decontaminate, jaccard, language_id, lines, pieces
from tallygraph.llm.common import materialize


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null, empty and letterless texts go, and so does text far from every profile."""
    return language_id.keep_identified(docs, max_distance=language_id.MAX_DISTANCE, doubtful=language_id.DOUBTFUL, min_lead=language_id.MIN_LEAD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that equal or nearly equal an earlier one; one that loses all its lines goes."""
    return lines.dedup_lines(docs, bands=lines.BANDS, keep_emptied=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one_of_each(docs, width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, nbest_scores and nbest_ids of every document that is left, and the text decoded from ids."""
    return pieces.encode_documents(docs, decoded=True)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("ngram_jaccard", drop_near_duplicates), ("decontaminate", drop_contaminated), ("sentencepiece", encode)]
#: Learned profiles, numpy and a vocabulary file have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
