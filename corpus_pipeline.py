"""Corpus preparation in stages: language ID, near duplicates, substring dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm.decontaminate import drop_contaminated
from strataq.llm.jaccard_join import keep_one
from strataq.llm.language_id import keep_identified
from strataq.llm.packing import pack
from strataq.llm.runtime import materialize, table
from strataq.llm.substring_dedup import deduplicated


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with similar sets of five words the one of smallest id."""
    return keep_one(docs, n=5, threshold=0.8)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that a document of smaller id holds."""
    return deduplicated(docs, width=13)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024."""
    import public_tokenizers

    return pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), window=1024)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Learned language models and token ids are not for SQL to express; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
