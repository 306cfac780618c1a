"""Reading page text, stored reports, terminology and range bundles; writing results (S1-S6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medtab import schemas
from medtab.sources import checked

#: A stored report as nested JSON.
REPORT = ("document struct<file_name:string,page_count:int,source_type:string,extractor:string>, sections array<struct<title:string,page:int,text:string>>, "
          "tables array<struct<title:string,page:int,headers:array<string>,rows:array<struct<name:string,value:string,unit:string,reference_range:string>>>>, "
          "measurements array<struct<name:string,value:string,unit:string,reference_range:string,page:int,source_section:string>>")
#: A range bundle: entries with one observation definition each.
BUNDLE = ("entry array<struct<resource:struct<code:struct<coding:array<struct<code:string,display:string>>>,"
          "qualifiedInterval:array<struct<category:string,gender:string,range:struct<low:struct<value:double,unit:string>,high:struct<value:double,unit:string>>>>>>>")


def as_pages(raw: DataFrame) -> DataFrame:
    """Extractor rows as ``pages``: page numbers from 1 (``page_number``, else 0-based ``page``), defaults for the rest."""
    has = set(raw.columns)
    number = F.coalesce(*([F.col("page_number").cast("int")] if "page_number" in has else []), *([F.col("page").cast("int") + 1] if "page" in has else []), F.lit(1))
    given = lambda name, default, kind: F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in has else F.lit(default).cast(kind)
    return raw.select(F.col("doc_id").cast("string").alias("doc_id"), number.alias("page"), given("text", "", "string").alias("text"), given("fmt", "markdown", "string").alias("fmt"),
                      given("extractor", "primary", "string").alias("extractor"), given("success", True, "boolean").alias("success"), given("n_images", 0, "int").alias("n_images"),
                      (F.coalesce("errors", F.array().cast("array<string>")) if "errors" in has else F.array().cast("array<string>")).alias("errors"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``pages`` from Parquet or JSON rows, or from whole text files (one page each, named after the file)."""
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return as_pages(files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"), F.lit("plain").alias("fmt")))
    return as_pages(spark.read.format(fmt).load(path))


def checked_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """``pages`` and the failures of what can't be read as one: broken records, cut-off files, rows without a document."""
    if fmt == "text":
        rows, failures = checked.read_text(spark, path)
        return as_pages(rows.select(F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"), F.lit("plain").alias("fmt"))), failures
    needed = F.coalesce("doc_id", F.lit("")) != ""
    rows, failures = checked.read_json(spark, path, checked.RAW_PAGES, needed) if fmt == "json" else checked.read_parquet(spark, path, checked.RAW_PAGES, needed)
    return as_pages(rows), failures


def read_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Stored nested reports as ``documents``, ``sections``, ``table_rows`` and ``measurements`` tables, and ``failures`` of files
    that hold no such report."""
    parsed, failures = checked.read_json(spark, path, REPORT, _some_part(), whole=True)
    raw = parsed.withColumn("doc_id", F.coalesce("document.file_name", F.element_at(F.split("file", "/"), -1)))
    sections = raw.select("doc_id", F.posexplode("sections").alias("k", "s")).select("doc_id", "s.page", (F.col("k") + 1).alias("section_no"), "s.title", "s.text")
    tables = raw.select("doc_id", F.posexplode("tables").alias("t", "x")).select("doc_id", "x.page", (F.col("t") + 1).alias("table_no"), "x.title", "x.headers", F.posexplode("x.rows").alias("r", "y"))
    rows = tables.select("doc_id", "page", "table_no", (F.col("r") + 1).alias("row_no"), "title", "headers", F.array("y.name", "y.value", "y.unit", "y.reference_range").alias("cells"), "y.*",
                         F.create_map().cast("map<string,string>").alias("extra"))
    found = raw.select("doc_id", F.explode("measurements").alias("m")).select("doc_id", "m.page", "m.name", "m.value", "m.unit", "m.reference_range", "m.source_section")
    return {"documents": raw.select("doc_id", "document.*"), "sections": sections, "table_rows": rows, "measurements": found, "failures": failures}


def _some_part() -> Column:
    """A report has one of its parts at least."""
    return F.col("document").isNotNull() | F.col("sections").isNotNull() | F.col("tables").isNotNull() | F.col("measurements").isNotNull()


def read_terminology(spark: SparkSession, path: str, ambiguous_domains: list[str] | None = None, safety: list[str] | None = None) -> DataFrame:
    """Pipe-delimited terms ``form|meaning[|domain]`` after the line ``ENTRIES``, one row for each form and candidate.

    Slashed forms are several forms; " OR " and ";" separate candidates, which are title-cased; the domain is "general"
    where none is given. ``ambiguous``: more than one candidate, or a domain of the list; ``is_safety``: form of the list.
    """
    # each file by itself: its lines behind its own ENTRIES line
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("ls"))
    start = F.array_position(F.transform("ls", lambda x: F.upper(F.trim(x))), "ENTRIES")
    lines = whole.withColumn("start", start).where("start > 0").select("start", F.posexplode(F.slice("ls", F.col("start") + 1, F.size("ls"))).alias("k", "line"))
    fields = lines.select((F.col("start") + F.col("k")).cast("int").alias("line_no"), F.transform(F.split("line", r"\|"), lambda x: F.trim(x)).alias("f")).where((F.size("f") >= 2) & (F.get("f", F.lit(0)) != ""))
    forms = fields.select("line_no", F.explode(F.filter(F.transform(F.split(F.get("f", F.lit(0)), "/"), lambda x: F.trim(x)), lambda x: x != "")).alias("surface_form"),
                          F.filter(F.transform(F.split(F.get("f", F.lit(1)), r" OR |;"), lambda x: F.initcap(F.trim(x))), lambda x: x != "").alias("cs"),
                          F.coalesce(F.nullif(F.try_element_at("f", F.lit(3)), F.lit("")), F.lit("general")).alias("domain"))
    rows = forms.select("line_no", "surface_form", "domain", F.explode("cs").alias("candidate"))
    per = Window.partitionBy(F.lower("surface_form"))
    many = F.size(F.collect_set("candidate").over(per)) > 1
    flagged = F.max(F.col("domain").isin(ambiguous_domains or ["ambiguous"])).over(per)
    return rows.select("surface_form", "candidate", "domain", F.lower("surface_form").isin([s.lower() for s in safety or []]).alias("is_safety"), "line_no", (many | flagged).alias("ambiguous"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Bundles of observation definitions as ``reference_ranges``, each with its first coding's code."""
    return checked_ranges(spark, path)[0]


def checked_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``reference_ranges`` and the failures of files that hold no bundle."""
    raw, failures = checked.read_json(spark, path, BUNDLE, F.col("entry").isNotNull(), whole=True)
    one = raw.select(F.explode("entry.resource").alias("r")).select(F.get("r.code.coding", F.lit(0))["code"].alias("code"), F.posexplode("r.qualifiedInterval").alias("interval_no", "q"))
    return one.where("code is not null").select("code", F.lower("q.gender").alias("gender"), F.coalesce("q.category", F.lit("reference")).alias("category"), "interval_no",
                                                F.col("q.range.low.value").alias("low"), F.col("q.range.high.value").alias("high"), F.coalesce("q.range.low.unit", "q.range.high.unit").alias("unit")), failures


def write_store(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each table as Parquet under its name; rows of the final report also as JSON text."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
        if name == "final_reports":
            df.select("doc_id", F.to_json(F.struct("*")).alias("report")).write.mode(mode).parquet(f"{path.rstrip('/')}/{name}_json")


def failure_rows(pages: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Documents none of whose pages succeeded, as ``quality`` rows of status FAILED with their errors; of ``failures`` of a checked
    reader, the files too."""
    docs = pages.groupBy("doc_id").agg(F.max("success").alias("any"), F.array_distinct(F.flatten(F.collect_list("errors"))).alias("warnings"))
    failed = docs.where(~F.coalesce("any", F.lit(False))).select("doc_id", F.lit("FAILED").alias("status"), F.lit(0.0).alias("aggregate"), F.array_sort("warnings").alias("warnings"))
    return failed if failures is None else failed.unionByName(checked.as_quality(failures))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table of one of the schemas."""
    return spark.createDataFrame([], getattr(schemas, schema.upper(), schema))
