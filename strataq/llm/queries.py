"""The queries of this subpackage, by name: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataq.llm.chat_format import repair
from strataq.llm.decontaminate import contaminated
from strataq.llm.edit_counts import apply_edits, derived_edits, token_trees
from strataq.llm.jaccard_join import jaccard_join
from strataq.llm.language_id import identify
from strataq.llm.packing import pack
from strataq.llm.pii import personal_data
from strataq.llm.quality_rules import quality_rules
from strataq.llm.resampling import importance_resampling
from strataq.llm.runtime import materialize, table
from strataq.llm.substring_dedup import substring_dedup
from strataq.llm.url_filter import url_filter
from strataq.llm.warc import round_trip
from strataq.llm.whitening import embedding_whitening


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=13)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived_edits(table(spark, sf_dir, "documents"))
    stored = materialize(token_trees(docs, tokenizer=_tokenizer()))  # the trees are a table; edits come to it
    return apply_edits(stored, tokenizer=_tokenizer())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=_tokenizer(), window=1024)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening(table(spark, sf_dir, "embeddings"), components=16)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_decontamination": op3_decontamination,
    "op4_edit_aware_counts": op4_edit_aware_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_pii": op13_pii,
}
