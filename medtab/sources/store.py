"""Tables of documents in a layout for running again and for joins (S5).

A table is partitioned by a hash of the document (``part``) and bucketed by document. A run puts the rows of its documents:
what the table held of them before is replaced, other documents stay. Only the parts that hold documents of the run are
written, into a staging folder, and take the place of the old ones when the whole job commits, so a run that fails halfway
leaves the table as it was. Tables with the same buckets join by document without an exchange. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from medtab.operators.sides import small
from medtab.sources.scratch import kept

#: Parts and buckets of a table; a part's bucket should hold a few hundred megabytes at most.
PARTS, BUCKETS = 16, 16


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


@contextmanager
def _dynamic(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.sources.partitionOverwriteMode"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def open_table(spark: SparkSession, name: str, path: str, schema: StructType, parts: int = PARTS, buckets: int = BUCKETS) -> DataFrame:
    """Declare the table of a folder, whether it is there already or new, and return it.

    ``parts`` and ``buckets`` belong to the folder: open it with the same ones each time.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, part int) USING parquet PARTITIONED BY (part) CLUSTERED BY (doc_id) INTO {buckets} BUCKETS "
              f"LOCATION '{path}' TBLPROPERTIES ('parts' = '{parts}', 'buckets' = '{buckets}')")
    spark.createDataFrame([], StructType([*schema.fields]).add("part", IntegerType())).write.partitionBy("part").mode("append").parquet(path)  # the folder, where it is new
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def _property(spark: SparkSession, name: str, key: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {name} ('{key}')").first()["value"])


def put(spark: SparkSession, name: str, rows: DataFrame, docs: DataFrame | None = None) -> None:
    """Replace what the table holds of the run's documents by ``rows``.

    The run's documents are those of ``rows`` and of ``docs(doc_id)``: one that stands in ``docs`` alone has no rows from now
    on. Rows without a document are a document of their own. Further columns of ``rows`` are left out.
    """
    parts, buckets = _property(spark, name, "parts"), _property(spark, name, "buckets")
    held = spark.table(name)
    new = kept(rows.withColumn("part", part_of(parts)).select(held.columns), "put")
    run = new.select("doc_id") if docs is None else new.select("doc_id").unionByName(docs.select("doc_id"))
    run = kept(run.distinct().select(F.col("doc_id").alias("run_id"), part_of(parts).alias("run_part")), "run")
    touched = [r.run_part for r in run.select("run_part").distinct().collect()]  # at most `parts` numbers
    stays = held.where(F.col("part").isin(touched)).join(small(run.select("run_id")), F.col("doc_id").eqNullSafe(F.col("run_id")), "left_anti")
    filled = {r.part for r in stays.select("part").unionByName(new.select("part")).distinct().collect()}
    with _dynamic(spark):
        stays.unionByName(new).repartition(buckets, "doc_id").write.insertInto(name, overwrite=True)
    for part in sorted(set(touched) - filled):  # an overwrite leaves alone what it has no rows for
        folder = spark.table(name).where(F.col("part") == part)
        if not folder.isEmpty():
            _clear(spark, name, part)
    spark.catalog.refreshTable(name)


def _clear(spark: SparkSession, name: str, part: int) -> None:
    """Empty one part."""
    kinds = StructType([f for f in spark.table(name).schema.fields if f.name != "part"])
    spark.createDataFrame([], kinds).createOrReplaceTempView("medtab_no_rows")
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (part = {part}) SELECT * FROM medtab_no_rows")
    spark.catalog.dropTempView("medtab_no_rows")
