"""The corpus pipeline: five stages over `documents`, each one operator of ticktide.llm.

Every stage works on all that its predecessor kept. All but the last return the columns of
`documents`, further ones too, whatever their names; the last returns the packed pieces with their token
ids. Nulls in any column, empty and very long texts, repeated rows and empty tables are defined by each
stage's operator: a document without text is rejected by the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ticktide.llm.common import remove, shared_dir
from ticktide.llm.exact_dedup import exact_dedup
from ticktide.llm.near_jaccard import near_jaccard_dedup
from ticktide.llm.packing import pack
from ticktide.llm.quality import quality_filter
from ticktide.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more, the one with the smallest id stays."""
    return near_jaccard_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document, or an earlier place, has already are cut out."""
    return suffix_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of balanced cost, a row per piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("suffix dedup", passages), ("packing", packing)]

#: The near-duplicate, suffix and packing stages can't be written as SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again.

    A stage's folder goes when the next one is written; the last stays, since the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{place}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            remove(spark, f"{place}/{k - 1}")
    return docs
