"""The training-data pipeline: stages over the table documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents. Stages judge rows by themselves or by numbers of their own, never by the id: rows without an id,
or that repeat one, fare as their texts do.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontam, dedup, langid, pii
from foliant.llm.common import stored, table
from foliant.llm.queries import LANGUAGES, pii_key


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; their column lang becomes the language found."""
    return langid.in_languages(docs, LANGUAGES)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return dedup.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for the personal data in their texts."""
    return pii.replace_pii(docs, pii_key(spark)).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the token ids of their texts, and how many these are."""
    encoded = bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("language", language_stage), ("dedup", dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("encoding", encoding_stage)]
ORACLE_SQL = None  # language models, signatures and keyed surrogates are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
