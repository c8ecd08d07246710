"""From raw documents to token ids: five stages, built from the corpus operators.

Each stage works on all that the one before it kept. ``run`` writes a stage's rows to the shared
folder as Parquet and reads them back as the next one's documents.

Defined results, for every stage: null text counts as empty, and is kept as null; empty tables give empty ones; texts of any
length are read whole; rows that repeat doc_id and text are one near duplicate of each other; of ties the smallest doc_id stays,
null doc_ids last; other columns are carried along, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, mixing, quality, simhash, suffix_dedup
from tessera.llm.common import stage, table, unstage

PASSAGE_WORDS = 51


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from two thirds of the labels, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), where=quality.fold(F.col("doc_id"), 3) != 1)
    return quality.score(docs, model, passing=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of passages of over 50 words."""
    return suffix_dedup.remove(docs, words=PASSAGE_WORDS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled such that sources, languages and topics meet their targets."""
    return mixing.mix(docs, keep=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before, docs = docs, stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)  # nothing reads it any more; the given table is left alone
    return STAGES[-1][1](spark, docs, sf_dir)
