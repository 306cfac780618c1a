"""A training-data pipeline over the documents table: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medtab.llm.common import cut, table
from medtab.llm.decontaminate import contamination
from medtab.llm.jaccard_join import jaccard_components
from medtab.llm.language_id import identify
from medtab.llm.source_mixing import mix
from medtab.llm.token_store import token_digest

#: Columns that every stage but the last passes on.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts."""
    return identify(docs, COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``row_key``, never null: a 64-bit hash of id and text, shared only by rows that repeat both."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row_key"), *COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id; texts without words all stay.

    Groups are made of texts, whatever the ids: rows without an id belong to the group of their text, and one of them stays
    only where no row of the group has an id; of rows that repeat id and text one stays; rows that share an id but not
    their text are judged each by itself.
    """
    rows = keyed(docs)
    found = jaccard_components(rows.select(F.col("row_key").alias("doc_id"), "text")).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("row_key")).agg(F.min("component_id").alias("group"), F.count("*").alias("copies"))
    named = cut(found.join(rows.groupBy("row_key").agg(F.min("doc_id").alias("id")), "row_key"), "named")
    best = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key"))["row_key"].alias("best"))
    judged = cut(named.join(best, "group").where("row_key <> best or copies > 1").select("row_key", (F.col("row_key") == F.col("best")).alias("stays")), "judged")
    out = rows.join(judged, "row_key", "left_anti").select(*COLUMNS)
    repeated = judged.where("stays").select("row_key")
    if repeated.isEmpty():
        return out
    rn = F.row_number().over(Window.partitionBy("row_key").orderBy("lang", "source", "n_chars"))
    return out.unionByName(rows.join(repeated, "row_key", "left_semi").withColumn("rn", rn).where("rn = 1").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window; each text is judged by itself, without an id or with a shared one."""
    rows = keyed(docs)
    hit = contamination(rows.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("row_key"))
    return rows.join(hit, "row_key", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares meet the target weights."""
    return mix(docs, COLUMNS).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of what is left, described document by document as the files hold it."""
    return token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_store", token_stage),
]

#: The first and last stage run a trained model and a tokenizer, which SQL can't express; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; ``(doc_id, start, n_tokens, ids_crc32)`` of what the pipeline keeps."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
