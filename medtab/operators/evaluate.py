"""Evaluation and corpus analytics (V1-V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that explanations must not use.
FORBIDDEN = r"(?i)\b(diagnos(?:is|ed|e)|you have|cancer|dangerous|fatal|urgent(?:ly)?|emergency|prescribe|treat(?:ment)?)\b"


def extraction_comparison(log: DataFrame) -> DataFrame:
    """``log(extractor, success, seconds, n_chars)`` by extractor: runs, successes, mean seconds, median characters."""
    return log.groupBy("extractor").agg(F.count("*").alias("runs"), F.count_if("success").alias("succeeded"), F.round(F.avg("seconds"), 4).alias("mean_seconds"),
                                        F.percentile("n_chars", 0.5).alias("median_chars"))


def accuracy(pairs: DataFrame, predicted: str = "predicted", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of boolean predictions; a measure without cases is null."""
    p, y = F.col(predicted), F.col(label)
    c = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(p == y).alias("right"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    part = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return c.select(*(by or []), "n", part(F.col("right"), F.col("n")).alias("accuracy"), part(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), part(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def coverage(resolutions: DataFrame) -> DataFrame:
    """Share of terms with a normal form."""
    return resolutions.agg(F.count("*").alias("n"), F.count("normalized").alias("covered"), F.round(F.count("normalized") / F.count("*"), 4).alias("share"))


def terminology_statistics(terminology: DataFrame) -> DataFrame:
    return terminology.agg(F.count("*").alias("records"), F.count_distinct(F.lower("surface_form")).alias("forms"), F.count_distinct(F.when(F.col("ambiguous"), F.lower("surface_form"))).alias("ambiguous_forms"),
                           F.count_distinct(F.when(F.col("is_safety"), F.lower("surface_form"))).alias("safety_forms"))


def forbidden_words(explanations: DataFrame) -> DataFrame:
    """Forbidden words in explanations, by word."""
    words = explanations.where(F.col("explanation").rlike(FORBIDDEN)).select("doc_id", F.explode(F.regexp_extract_all("explanation", F.lit(FORBIDDEN), F.lit(0))).alias("word"))
    return words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def fact_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(doc_id, n_<table> ...)``: rows of each fact table by document."""
    rows = None
    for name, df in tables.items():
        one = df.select("doc_id", F.lit(name).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in tables))


def counts_rollup(counts: DataFrame, classified: DataFrame) -> DataFrame:
    """Fact counts by report type and status, with subtotals."""
    names = [c for c in counts.columns if c != "doc_id"]
    return classified.join(counts, "doc_id", "left").rollup("report_type", "status").agg(F.count("*").alias("n_docs"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
