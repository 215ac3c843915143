"""A training-corpus pipeline: each stage is one operator over what the one before kept.

Language ID drops texts in no known language; the Jaccard join keeps one of each
group of near duplicates; substring deduplication removes repeated passages;
decontamination drops documents that hold benchmark items; SentencePiece encodes
the rest. Every stage takes nulls in any column, repeated rows and an empty table,
which gives an empty result, and but for the last returns the columns it was given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, jaccard, language, pieces, substring
from docloom.llm.storage import cut


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known to a model fitted on the labelled ones; `und` and texts it hardly knows go."""
    return language.keep_identified(docs, language.fit(docs, ~language.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least number of each group."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur earlier, n_chars recounted; texts of which nothing is left go."""
    return substring.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece_ids, round_trip) of each document left."""
    return pieces.encode(docs, decoded=True).select("doc_id", "piece_ids", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", encode),
]

#: Bloom filters of n-grams, templates with consistent slots and Viterbi passes aren't SQL; the tests hold each stage against brute force or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each computed once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
