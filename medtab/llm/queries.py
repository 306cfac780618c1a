"""The queries of the training-data operators, each over its whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medtab.llm import decontaminate, source_mixing, token_rollup, topk_search, url_filter
from medtab.llm.common import table
from medtab.llm.conversation_repair import repair
from medtab.llm.jaccard_join import jaccard_components
from medtab.llm.language_id import language_id
from medtab.llm.personal_data import digest
from medtab.llm.quality_rules import quality
from medtab.llm.token_store import token_digest
from medtab.llm.toxicity import toxicity
from medtab.llm.whitening import whiten


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: rules learned outside the held-out fold, scored as one column expression."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of the documents after a history of inserts, deletes and revisions."""
    return token_rollup.replay(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept when sources, languages and topics are raked to their target weights."""
    return source_mixing.sampled(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active when it was fetched."""
    return url_filter.filtered_pages(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the learned lexicon."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    return language_id(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and described document by document."""
    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they come from."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and the cheapest edits that give it a legal structure."""
    return repair(table(spark, sf_dir, "conversations"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: what the patterns find, and what a tagger trained on it adds."""
    return digest(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the first components of the covariance of all distinct vectors, scaled to unit variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_rollup": op2_token_rollup,
    "op3_source_mixing": op3_source_mixing,
    "op4_topk_search": op4_topk_search,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_token_store": op9_token_store,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_personal_data": op12_personal_data,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op2_token_rollup": token_rollup.replayed_sql(),
    "op3_source_mixing": source_mixing.sql(),
    "op4_topk_search": topk_search.SQL,
    "op5_url_filter": url_filter.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
