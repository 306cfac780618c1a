"""Registered queries over what is read, stored and streamed: broken input, the store of documents, terms asked once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medtab.operators import layout
from medtab.plans import synth
from medtab.plans.queries import query
from medtab.plans.synth import ITEMS_SQL, table
from medtab.sources import checked, pages, store
from medtab.sources.scratch import scratch_path
from medtab.streaming import intake


@query(r"""WITH d AS (SELECT doc_id % 7 AS r, length(coalesce(text, '')) AS n FROM documents)
SELECT CASE r WHEN 0 THEN 'broken JSON' WHEN 1 THEN 'a value of another type' WHEN 2 THEN 'a needed field is missing' ELSE 'read' END AS outcome, count(*) AS n_rows, CAST(sum(CASE WHEN r > 2 THEN n ELSE 0 END) AS BIGINT) AS n_chars FROM d GROUP BY 1""")
def malformed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON lines, three of seven broken: cut off, with a page that is no number, without a name."""
    r = F.col("doc_id") % 7
    rows = table(spark, sf_dir, "documents").select(r.alias("r"), F.to_json(F.struct(F.when(r != 2, F.col("doc_id").cast("string")).alias("doc_id"), F.when(r == 1, "first").alias("page"), F.coalesce("text", F.lit("")).alias("text"))).alias("value"))
    path = scratch_path(spark, "json_pages")
    rows.select(F.when(F.col("r") == 0, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")).alias("value")).write.text(path)
    good, failures = pages.checked_pages(spark, path, "json")
    return (good.select(F.lit("read").alias("outcome"), F.length("text").alias("n")).unionByName(failures.select(F.col("reason").alias("outcome"), F.lit(0).alias("n")))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_chars")))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT CASE WHEN k % 5 < 2 THEN 'FAILED' ELSE 'read' END AS status, CASE k % 5 WHEN 0 THEN 'broken JSON' WHEN 1 THEN 'a value of another type' ELSE '' END AS reason, count(*) AS n_files, CAST(sum(CASE WHEN k % 5 < 2 THEN 0 ELSE n END) AS BIGINT) AS n_measurements FROM c GROUP BY ALL""")
def malformed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested report a nation, with its customers as measurements; two of five files are cut off or hold a word for a number."""
    customers = table(spark, sf_dir, "customer")
    found = F.collect_list(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("value"), F.lit(1).alias("page")))
    per = customers.groupBy(F.col("c_nationkey").alias("k")).agg(found.alias("measurements"))
    count = F.when(F.col("k") % 5 == 1, F.lit('"many"')).otherwise(F.lit("1"))
    text = F.concat(F.lit('{"document": {"file_name": "n'), F.col("k").cast("string"), F.lit('", "page_count": '), count, F.lit('}, "measurements": '), F.to_json("measurements"), F.when(F.col("k") % 5 == 0, "").otherwise("}"))
    path = scratch_path(spark, "json_reports")
    per.select("k", text.alias("value")).repartition("k").write.partitionBy("k").text(path)
    got = pages.read_reports(spark, f"{path}/k=*")
    sizes = got["measurements"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    good = got["documents"].select("doc_id").join(sizes, "doc_id", "left").select(F.lit("read").alias("status"), F.lit("").alias("reason"), F.coalesce("n", F.lit(0)).alias("n"))
    bad = checked.as_quality(got["failures"]).select("status", F.array_join("warnings", "; ").alias("reason"), F.lit(0).cast("long").alias("n"))
    return good.unionByName(bad).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_measurements"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderstatus END AS status, count(l_orderkey) AS n_rows, CAST(coalesce(sum(CAST(l_quantity AS BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END), 0) AS BIGINT) AS total
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 6 <> 0 GROUP BY 1, 2""")
def store_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored tables of all orders; a third of the orders runs again with other values, half of these without rows. Joined as stored."""
    path, mark = scratch_path(spark, "store"), uuid.uuid4().hex
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_quantity").cast("long").alias("quantity"))
    again = docs.where("k % 3 = 0")
    names = {n: f"medtab_{n}_{mark}" for n in ("documents", "measurements")}
    for name, first, second in (("documents", docs, again.withColumn("status", F.lit("again"))), ("measurements", rows, rows.where("k % 3 = 0 and k % 6 <> 0").withColumn("quantity", F.col("quantity") + 100))):
        store.open_table(spark, names[name], f"{path}/{name}", first.drop("k").schema, parts=4, buckets=8)
        store.put(spark, names[name], first)
        store.put(spark, names[name], second, again)
    both = spark.table(names["documents"]).drop("part").join(spark.table(names["measurements"]).drop("part"), "doc_id", "left")
    return both.groupBy("doc_id", "status").agg(F.count("quantity").alias("n_rows"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("total"))


@query(r"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS key FROM documents)
SELECT key, CASE WHEN length(key) % 4 = 0 THEN '__NO_RESULT__' ELSE upper(key) END AS definition, CAST(1 AS BIGINT) AS n_asked FROM w WHERE length(key) > 3""")
def terms_asked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents as a stream of terms in four files, each asked for once; short words have been defined before."""
    base = scratch_path(spark, "terms")
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))).alias("term"))
    words.select((F.col("doc_id") % 4).alias("part"), "term").distinct().repartition(4, "part").select("term").write.parquet(f"{base}/land")
    old = words.where(F.length("term") <= 3).select(F.col("term").alias("key")).distinct()
    answer = lambda keys: keys.where(F.length("key") % 4 != 0).select("key", F.upper("key").alias("definition"), F.lit("word").alias("category"))
    intake.ask_once(spark, f"{base}/land", f"{base}/definitions", f"{base}/checkpoint", answer, [old], files_per_batch=1)
    return intake.definitions(spark, f"{base}/definitions").groupBy("key").agg(F.min("definition").alias("definition"), F.count(F.lit(1)).alias("n_asked"))


@query(f"""WITH RECURSIVE {ITEMS_SQL}, w AS (SELECT l_orderkey AS d, rn AS k, (l_partkey % 4) * 4 + l_suppkey % 3 AS y, (l_partkey % 11) * 20 AS x FROM items),
f AS (SELECT DISTINCT d, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS a FROM w UNION ALL SELECT f.d, w.k, CASE WHEN len([z FOR z IN a IF abs(z - y) <= 3]) > 0 THEN a ELSE list_append(a, y) END FROM f JOIN w ON w.d = f.d AND w.k = f.k + 1),
p AS (SELECT w.d, w.k, x, [z FOR z IN a IF abs(z - y) <= 3][1] AS z FROM w JOIN (SELECT d, arg_max(a, k) AS a FROM f GROUP BY d) USING (d)),
g AS (SELECT *, dense_rank() OVER (PARTITION BY d ORDER BY z) AS line_no, lag(x) OVER (PARTITION BY d, z ORDER BY x, k) AS px FROM p)
SELECT CAST(d AS VARCHAR) AS doc_id, line_no, string_agg((CASE WHEN px IS NULL THEN '' WHEN x - (px + 10) > 25 THEN ' | ' ELSE ' ' END) || 'w' || k, '' ORDER BY x, k) AS line FROM g GROUP BY d, line_no""")
def lines_jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as word boxes whose heights drift by less than the gap from one to the next."""
    x, y = (F.col("l_partkey") % 11) * 20, (F.col("l_partkey") % 4) * 4 + F.col("l_suppkey") % 3
    words = synth.items(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("rn").alias("word_no"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 10).cast("double").alias("x1"),
                                              (y + 8).cast("double").alias("y1"), F.concat(F.lit("w"), F.col("rn").cast("string")).alias("text"))
    return layout.rebuild_lines(words).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
