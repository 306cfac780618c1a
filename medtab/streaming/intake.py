"""Report intake: pages as they arrive, the batch operators on each micro-batch, job status as a table (J1-J3)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medtab import schemas
from medtab.operators import job, layout, quality
from medtab.operators.report import NO_RESULT
from medtab.operators.sides import small
from medtab.sources.scratch import kept

ACCEPTED = ["markdown", "plain"]


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Pages from Parquet files as they land in a folder."""
    return spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def status_of(pages: DataFrame, classified: DataFrame | None = None, whole_numbers: bool = True) -> DataFrame:
    """``(doc_id, status, error)``: failed for a wrong format, a failed extraction, a failed quality gate or a report type
    that is UNKNOWN or AMBIGUOUS; done otherwise."""
    per = pages.groupBy("doc_id").agg(F.max((~F.coalesce("fmt", F.lit("")).isin(ACCEPTED)).cast("int")).alias("wrong"), F.max(F.coalesce("success", F.lit(True)).cast("int")).alias("any"))
    q = quality.quality(layout.assemble(pages, marker=False), whole_numbers=whole_numbers).select("doc_id", F.col("status").alias("quality"))
    out = per.join(q, "doc_id")
    out = out.join(classified.select("doc_id", F.col("status").alias("type_status")), "doc_id", "left") if classified is not None else out.withColumn("type_status", F.lit(None).cast("string"))
    error = (F.when(F.col("wrong") == 1, "unsupported format").when(F.col("any") == 0, "extraction failed").when(F.col("quality") == "FAILED", "quality check failed")
             .when(F.col("type_status").isin("UNKNOWN", "AMBIGUOUS"), F.concat(F.lit("report type "), F.lower("type_status"))))
    return out.select("doc_id", F.when(error.isNull(), "done").otherwise("failed").alias("status"), error.alias("error"))


_STATUS = "doc_id string, status string, error string"


def run_intake(spark: SparkSession, folder: str, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Drain the landing folder: each micro-batch is processed and its job statuses written under its batch id.

    A batch that runs again after a failure overwrites its own folder, so statuses are exactly once; ``process`` gives more
    columns of status rows (by default ``status_of``).
    """
    step = process or status_of
    # an empty batch before the first, so that readers find a table wherever the stream has run
    spark.createDataFrame([], f"{_STATUS}, batch_id long").write.mode("overwrite").parquet(f"{out}/batch=-1")

    def batch(df: DataFrame, batch_id: int) -> None:
        step(df).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = page_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_status(spark: SparkSession, out: str) -> DataFrame:
    """The status of each document's last batch."""
    rows = spark.read.parquet(f"{out}/batch=*")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("status", "error"), "batch_id").alias("s"), F.max("batch_id").alias("batch_id")).select("doc_id", "s.status", "s.error", "batch_id")


def first_seen(pages: DataFrame, delay: str = "1 day", time: str = "arrived") -> DataFrame:
    """A stream without documents delivered again within the delay."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["doc_id", "page"])


def new_terms(terms: DataFrame, definitions: DataFrame) -> DataFrame:
    """Terms not looked up yet: distinct, and without a definition row (also one of no result)."""
    return terms.select(F.lower(F.trim("term")).alias("key")).where("key <> ''").distinct().join(definitions.select(F.lower("key").alias("key")), "key", "left_anti")


def definitions(spark: SparkSession, out: str) -> DataFrame:
    """``(key, definition, category, stream, batch)``: what `ask_once` has asked for; no answer stands as report.NO_RESULT."""
    return spark.read.parquet(out)


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint: batches are numbered from 0 again without it."""
    path = f"{checkpoint}/stream_name"
    try:
        return spark.read.schema("name string").parquet(path).first()["name"]
    except AnalysisException:
        spark.createDataFrame([(uuid.uuid4().hex,)], "name string").write.parquet(path)
        return spark.read.parquet(path).first()["name"]


def ask_once(spark: SparkSession, folder: str, out: str, checkpoint: str, look_up: Callable[[DataFrame], DataFrame], others: list[DataFrame] | None = None,
             files_per_batch: int = 100) -> None:
    """Drain a folder of terms (Parquet, ``term``): each term without a definition goes to ``look_up`` once.

    ``look_up`` takes ``(key)`` and gives ``(key, definition, category)``; of several answers the first in order counts, and a key
    without one is kept as asked without result. The stream's state holds the keys of all its batches; the definitions at the
    start of each batch (its own table ``out``, which grows, and ``others``) take out what was asked before that state, such
    as by a stream whose checkpoint is lost. A batch that runs again leaves its own answers out of account and overwrites them.
    """
    name = _stream_name(spark, checkpoint)
    spark.createDataFrame([], "key string, definition string, category string").write.mode("overwrite").parquet(f"{out}/stream=none/batch=-1")

    def batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        new = kept(df, "terms")
        known = definitions(session, out).where((F.col("batch") != batch_id) | (F.col("stream") != name)).select("key")
        for side in others or []:
            known = known.unionByName(side.select(F.lower(F.trim("key")).alias("key")))
        known = known.join(small(new), "key", "left_semi").distinct()  # of a large table only what this batch names
        asked = kept(new.join(known, "key", "left_anti"), "asked")
        answers = look_up(asked).groupBy("key").agg(F.min(F.struct("definition", "category")).alias("a"))
        rows = asked.join(answers, "key", "left").select("key", F.coalesce("a.definition", F.lit(NO_RESULT)).alias("definition"), "a.category")
        rows.write.mode("overwrite").parquet(f"{out}/stream={name}/batch={batch_id}")

    terms = spark.readStream.schema("term string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    keys = terms.select(F.lower(F.trim("term")).alias("key")).where("key <> ''").dropDuplicates(["key"])
    keys.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_reports(spark: SparkSession, folder: str, out: str, checkpoint: str, tables: job.Tables, write: Callable[[DataFrame, str], None] | None = None) -> None:
    """Drain the landing folder through the whole job: statuses, concepts and final reports of each micro-batch.

    Before the work a batch states its documents as "processing". Then its tables are written, each into the batch's own
    folder, and last its manifest: readers see batches with a manifest only, so several tables appear at once. A batch that
    runs again after a failure, between two tables or anywhere else, overwrites its own folders. Documents whose type is
    UNKNOWN or AMBIGUOUS fail like those that miss the quality gate, and have no report.
    """
    put = write or (lambda df, path: df.write.mode("overwrite").parquet(path))
    spark.createDataFrame([], _STATUS).write.mode("overwrite").parquet(f"{out}/states/batch=-1/phase=0")
    spark.createDataFrame([], "at timestamp").write.mode("overwrite").parquet(f"{out}/manifest/batch=-1")

    def batch(df: DataFrame, batch_id: int) -> None:
        pages = kept(df, "batch_pages")
        started = pages.select("doc_id").distinct().select("doc_id", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error"))
        put(started, f"{out}/states/batch={batch_id}/phase=0")
        fit = pages.where(F.coalesce("fmt", F.lit("")).isin(ACCEPTED) & F.coalesce("success", F.lit(True)))
        with job.plain_unions(df.sparkSession):
            sections, rows = job.parsed(fit)
            kinds = kept(job.classified(fit, sections, rows, tables), "classified")
            known = kinds.where(~F.col("status").isin("UNKNOWN", "AMBIGUOUS"))
            concepts = kept(job.facts_of(sections, rows, known, tables), "concepts")
        put(concepts, f"{out}/tables/concepts/batch={batch_id}")
        put(job.reported(sections, known, concepts, tables), f"{out}/tables/reports/batch={batch_id}")
        put(status_of(pages, kinds), f"{out}/states/batch={batch_id}/phase=1")
        put(df.sparkSession.range(1).select(F.current_timestamp().alias("at")), f"{out}/manifest/batch={batch_id}")

    page_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def published(spark: SparkSession, out: str, name: str, schema: str | StructType) -> DataFrame:
    """Rows of a table ("concepts", "reports") of all batches that have a manifest, with ``batch``; empty where there is none yet.

    A document that was delivered again stands in each of its batches; `latest` keeps the last."""
    done = spark.read.parquet(f"{out}/manifest").select("batch").where("batch >= 0")
    if done.isEmpty():
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.parquet(f"{out}/tables/{name}").join(F.broadcast(done), "batch", "left_semi")


def latest(rows: DataFrame) -> DataFrame:
    """Of published rows those of each document's last batch."""
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi")


def states(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, status, error, batch)``: each document's last state. What a batch without a manifest wrote after its start does
    not count yet."""
    done = spark.read.parquet(f"{out}/manifest").select(F.col("batch"), F.lit(True).alias("done"))
    rows = spark.read.parquet(f"{out}/states").join(F.broadcast(done), "batch", "left").where("phase = 0 or done")
    last = F.max_by(F.struct("status", "error", "batch"), F.struct("batch", "phase")).alias("s")
    return rows.groupBy("doc_id").agg(last).select("doc_id", "s.status", "s.error", "s.batch")
