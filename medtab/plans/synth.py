"""Report pages made from the columns of the test tables, so that a query parses back what its oracle reads directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of an order's line items: their key alone isn't unique.
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
#: The same in SQL, with the columns that queries read.
ITEMS_SQL = f"""items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ITEM_ORDER)}) AS rn,
  1 + p_size % 25 AS lo, 11 + p_size % 25 + p_size % 7 AS hi, CASE p_size % 3 WHEN 0 THEN 'mg' WHEN 1 THEN 'mm' ELSE '%' END AS unit,
  CASE l_returnflag WHEN 'R' THEN 'No ' WHEN 'A' THEN 'Mild ' ELSE 'Possible ' END AS lead
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part, document, number in the order, range bounds, unit and the word that leads their finding.

    They are dealt by document, so that what groups by ``doc_id`` deals none of them again.
    """
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("doc_id", F.col("l_orderkey").cast("string"))
    size = F.col("p_size")
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy(*ITEM_ORDER))
    lead = F.when(F.col("l_returnflag") == "R", "No ").when(F.col("l_returnflag") == "A", "Mild ").otherwise("Possible ")
    return rows.select("*", rn.alias("rn"), (1 + size % 25).alias("lo"), (11 + size % 25 + size % 7).alias("hi"), F.when(size % 3 == 0, "mg").when(size % 3 == 1, "mm").otherwise("%").alias("unit"), lead.alias("lead"))


def _joined(rows: str, text: Column, glue: str) -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.struct(F.col(rows), text.alias("t"))))["t"], glue)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages``: one Markdown page for each order, with a heading, a table of its items and a section of findings."""
    li = items(spark, sf_dir)
    row = F.concat(F.lit("| "), F.col("p_name"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), F.col("unit"), F.lit(" | "), F.col("lo").cast("string"), F.lit(" - "), F.col("hi").cast("string"), F.lit(" |"))
    parts = li.groupBy("doc_id").agg(_joined("rn", row, "\n").alias("rows"), _joined("rn", F.concat("lead", "p_name"), "; ").alias("findings"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    both = parts.join(orders, F.col("doc_id") == F.col("o_orderkey").cast("string"))
    text = F.concat(F.lit("## "), F.col("o_orderpriority"), F.lit("\nResults of the order\n| TEST | RESULT | UNIT | REFERENCE |\n|---|---|---|---|\n"), F.col("rows"), F.lit("\n\n## FINDINGS\n"), F.col("findings"), F.lit(".\n"))
    return both.select("doc_id", F.lit(1).alias("page"), text.alias("text"), F.lit("markdown").alias("fmt"), F.lit("primary").alias("extractor"), F.lit(True).alias("success"), F.lit(0).alias("n_images"),
                       F.array().cast("array<string>").alias("errors"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` of the documents table: one plain page for each line of a text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text", F.lit("plain").alias("fmt"), (F.col("p") % 3).alias("n_images"))
