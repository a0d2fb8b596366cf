"""A training-data pipeline in five stages over the documents table.

Each stage takes (spark, docs, sf_dir) with what its predecessor kept; the result is written as Parquet and read again
as the next one's input. All but the last return the columns of documents; the last returns what the token
shards hold of each document (see ``foliant.llm.token_shards``). A document that the mix takes twice is there twice.

Null, empty and very long texts, ties, repeated rows and empty tables are each operator's own defined cases: a null or
empty text passes the filters unless the classifier rejects it, has one representative in its class of equal texts, is
never taken by the mix, and so never reaches the shards.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import stored, table
from foliant.llm.cotraining import good_documents
from foliant.llm.decontaminate import clean_documents
from foliant.llm.mixing import mixed_documents
from foliant.llm.near_duplicates import without_near_duplicates
from foliant.llm.token_shards import token_shards

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, in training order."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in compressed shards, and what they hold of each document."""
    return token_shards(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: A trained classifier and sketches can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
