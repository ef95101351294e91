"""Corpus pipeline: from raw documents to token ids, stage by stage over all rows.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``; all but the last return the columns of documents.
``run(spark, sf_dir)`` applies them to ``documents``.

Extra columns pass through every stage but the last; null texts have no language and go in the first stage. SQL
cannot express the language model, so ``ORACLE_SQL`` is None and the tests hold ``run`` against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, language_id, line_dedup, ngram_join, sentencepieces
from ledgerlens.llm.sparkops import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rest (no letter, or no language above the least score) go."""
    model = language_id.train(language_id.training_rows(docs))
    return language_id.identified(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; documents that this empties go."""
    out = line_dedup.dedup_lines(docs)
    kept = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.where((F.col("kept_text") != "") | (F.col("n_removed") == 0)).select(
        *[kept.get(c, F.col(c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest (doc_id, text) of each component of near duplicates.

    Only rows equal in both are one document; rows that share an id, or have none, stand for themselves.
    """
    return ngram_join.smallest_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the piece ids of each document."""
    return sentencepieces.encode_documents(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
