"""A corpus pipeline of five stages; counted as part of the folder ``tidemark/llm``.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame``. It works on all rows that the
stage before kept and is written as Parquet before the next one reads it. All
but the last return the columns of ``documents``; the last returns the kept
documents as token ids.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.deploy import ensure
from tidemark.llm import bpe, langid, mixing, quality, simhash
from tidemark.llm.common import discard, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that break a rule go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language isn't clear go; the model learns from the rows' own labels and fills in missing ones."""
    ensure(spark)
    return langid.accepted(docs, langid.fit(docs), fill="lang")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id."""
    ensure(spark)
    return simhash.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics."""
    ensure(spark)
    marked, targets, values, tokens = mixing.documents(docs)
    return mixing.sample(marked, targets, values, tokens).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, ids (little-endian unsigned 32-bit)."""
    ensure(spark)
    ranks, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    encoded = bpe.encode(docs, ranks, pattern, release=True)
    return encoded.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("mixing_sources", mixing_sources),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither compression nor byte-pair merges; tests/llm checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
