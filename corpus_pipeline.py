"""From raw documents to token ids: five stages, each one operator of the training-data subpackage.

Every stage reads what its predecessor wrote and returns the columns of ``documents``; the last one
returns the encoded documents in training order: doc_id, n_tokens, ids (binary, little-endian
unsigned 32-bit integers). A document that the mix takes more than once has a row for each copy.

In every stage a null or empty text counts as one without words, so the first stage drops it; a null source is a
source of its own; null ids take part like others (last where an id decides). Rows that repeat id and text are one
document to the third stage, which also decides ties by id, then text; another text under a known id stays. Texts
are never cut, however long. Further columns, whatever their names, are carried to the fourth stage and have
no influence. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hyphaspark.llm import bpe, language_id, mixing, ngram_join, quality_rules, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language."""
    return language_id.keep(docs, language_id.train(docs.where(~language_id.held_out())))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are too short or too repetitive."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of (near) copies: shingles of five words, similarity 0.8."""
    return ngram_join.deduplicate(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the target weights of their sources, in training order."""
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: Language models and suffix arrays are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again. When a stage is written, its input and whatever it staged go."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in STAGES[:-1]:
        with shared.stage_alone(*read) as stage:
            docs = stage(function(spark, docs, sf_dir), name)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
