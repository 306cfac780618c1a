"""Readers that keep what can't be read: good rows, and a failure with its reason for every broken record or file (S1-S4, S6).

Each reader stores the parsed rows once in the shared folder, so that good rows and failures come from one pass over the input.
Failures are rows ``(file, reason, record)``: ``record`` is the text of a broken record, null where a whole file failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medtab.sources.scratch import kept

#: Extractor rows as they may arrive; further fields are ignored, absent ones are null.
RAW_PAGES = ("doc_id string, page int, page_number int, text string, fmt string, extractor string, success boolean, n_images int, "
             "errors array<string>")
FAILURES = "file string, reason string, record string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """``(file)``: the names of all files under a path, as the file index lists them; scans leave out empty ones."""
    names = spark.read.format("binaryFile").load(path).inputFiles()
    return spark.createDataFrame([(n,) for n in names], "file string").select(F.regexp_replace("file", "^file:/+", "file:/").alias("file"))


def _silent(spark: SparkSession, path: str, rows: DataFrame, reason: str) -> DataFrame:
    """Failures of the files that gave no row at all."""
    filled = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.lit(True).alias("filled"))  # no content is read
    out = files(spark, path).join(rows.select("file").distinct(), "file", "left_anti").join(filled, "file", "left")
    return out.select("file", F.when(F.col("filled").isNull(), "empty file").otherwise(reason).alias("reason"), F.lit(None).cast("string").alias("record"))


def read_json(spark: SparkSession, path: str, schema: str, needed: Column, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, failures)`` of JSON records, one a line or (``whole``) one a file.

    A record fails where it is no JSON ("broken JSON"), where a field has another type than the schema's ("a value of
    another type": the whole record fails, not the field alone) and where ``needed`` isn't true ("a needed field is
    missing"); a file fails where it holds no record. ``rows`` have the schema's columns and ``file``.
    """
    raw = spark.read.schema(f"{schema}, broken_record string").option("columnNameOfCorruptRecord", "broken_record").option("mode", "PERMISSIVE").option("multiLine", whole).json(path)
    raw = kept(raw.select("*", F.col("_metadata.file_path").alias("file")), "json")
    text = F.col("broken_record")
    blank = F.trim(F.coalesce(text, F.lit("x"))) == ""
    reason = (F.when(text.isNotNull() & F.try_parse_json(text).isNull(), "broken JSON").when(text.isNotNull(), "a value of another type")
              .when(~F.coalesce(needed, F.lit(False)), "a needed field is missing"))
    judged = raw.where(~blank).withColumn("reason", reason)
    bad = judged.where("reason is not null").select("file", "reason", text.alias("record"))
    return judged.where("reason is null").drop("reason", "broken_record"), bad.unionByName(_silent(spark, path, judged, "no record"))


def read_parquet(spark: SparkSession, path: str, schema: str, needed: Column) -> tuple[DataFrame, DataFrame]:
    """``(rows, failures)`` of Parquet files under a schema.

    A file that isn't Parquet, is cut off, or holds a column of another type fails as a whole. Where pages in its middle are
    damaged, the rows before them stay and the failure says how many of its rows, as its footer counts them, were read. A
    file without rows is told apart from an unreadable one by its footer's schema no more than by its rows: both fail.
    """
    read = lambda: spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    raw = kept(read().select("*", F.col("_metadata.file_path").alias("file")), "parquet")
    footers = read().groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))  # no column: footers only
    decoded = raw.groupBy("file").agg(F.count(F.lit(1)).alias("k"))
    damaged = footers.join(decoded, "file").where("k < n").select("file", F.concat(F.lit("damaged: "), F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" rows read")).alias("reason"), F.lit(None).cast("string").alias("record"))
    missing = raw.where(~F.coalesce(needed, F.lit(False))).select("file", F.lit("a needed field is missing").alias("reason"), F.to_json(F.struct(*[c for c in raw.columns if c != "file"])).alias("record"))
    rows = raw.where(F.coalesce(needed, F.lit(False)))
    return rows, missing.unionByName(damaged).unionByName(_silent(spark, path, raw, "unreadable, without rows, or with columns of another type"))


def read_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, failures)`` of whole text files: ``(file, name, value)``; files without text fail, as do those that aren't UTF-8."""
    raw = kept(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), "value"), "text")
    reason = F.when(F.col("value").contains("\0") | F.col("value").contains("�"), "not text")
    judged = raw.where(F.trim("value") != "").withColumn("reason", reason)
    bad = judged.where("reason is not null").select("file", "reason", F.lit(None).cast("string").alias("record"))
    return judged.where("reason is null").drop("reason"), bad.unionByName(_silent(spark, path, judged, "no text"))


def as_quality(failures: DataFrame) -> DataFrame:
    """Failures as ``quality`` rows of status FAILED, one for each file, named after it."""
    name = F.element_at(F.split("file", "/"), -1)
    per = failures.groupBy("file").agg(F.array_sort(F.collect_set("reason")).alias("warnings"))
    return per.select(name.alias("doc_id"), F.lit("FAILED").alias("status"), F.lit(0.0).alias("aggregate"), "warnings")
