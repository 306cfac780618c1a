"""Further registered queries: one for each operator that the main ones do not show by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medtab import dims
from medtab.functions.text import clean_text, strip_markup
from medtab.operators import classify, evaluate, facts, layout, quality, ranges, report, terms
from medtab.plans import queries as base
from medtab.plans import synth
from medtab.plans.queries import query
from medtab.plans.synth import ITEMS_SQL, table


def _sections_of(rows: DataFrame, key: str, order: str, text: Column, title: str, head: str = "") -> DataFrame:
    """One section for each key, made of lines in order."""
    lines = F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("t"))))["t"], "\n")
    by = "doc_id" if "doc_id" in rows.columns else F.col(key).cast("string").alias("doc_id")
    return rows.groupBy(by).agg(F.concat(F.lit(head), lines).alias("text")).select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("section_no"), F.lit(title).alias("title"), "text")


@query(f"WITH {base._TEXT_CHECKS} SELECT d.doc_id, d.source FROM documents d JOIN q USING (doc_id) WHERE status IN ('GOOD', 'DEGRADED')")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that go on after the gate."""
    docs = table(spark, sf_dir, "documents")
    return quality.gate(docs.select("doc_id", "source"), quality.quality(docs, whole_numbers=False))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean FROM documents""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_text(F.coalesce("text", F.lit("")))).alias("clean"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(replace(coalesce(text, ''), chr(10), chr(10) || chr(10))) AS INTEGER) AS n_chars FROM documents")
def assembled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put together again."""
    return layout.assemble(synth.document_pages(spark, sf_dir), marker=False).select("doc_id", F.length("text").alias("n_chars"))


@query(f"WITH {ITEMS_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(rn AS INTEGER) AS row_no, 'Panel' AS title, p_name AS name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value, unit FROM items")
def tables_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column-broken lines of plain pages as table rows."""
    row = F.concat(F.col("p_name"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), F.col("unit"))
    pages = _sections_of(synth.items(spark, sf_dir), "l_orderkey", "rn", row, "", "Panel\nTEST | RESULT | UNIT\n").drop("title", "section_no")
    return layout.tables_plain(pages).select("doc_id", "row_no", "title", "name", "value", "unit")


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT l_orderkey, rn, p_name || CASE rn % 3 WHEN 1 THEN ' B12' ELSE '' END AS name, CASE rn % 4 WHEN 2 THEN '<' ELSE '' END || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value_raw, unit, lo || ' - ' || hi AS reference_range,
  row_number() OVER (PARTITION BY l_orderkey, p_name, rn % 3 = 1 ORDER BY rn) AS k FROM items WHERE rn % 5 <> 0 AND unit <> '%')
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, name, value_raw, CASE WHEN value_raw LIKE '<%' THEN NULL ELSE CAST(value_raw AS DOUBLE) END AS value_num, unit, reference_range FROM c WHERE k = 1 AND (name LIKE '% B12' OR name NOT LIKE 'red %')""")
def cell_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows "name value lo - hi unit", every second with pipes, some with digits in the name or a sign before the value. Skipped are
    names that are known already (here: red things), administrative ones (every fifth row) and rows without a unit."""
    li = synth.items(spark, sf_dir)
    rn = F.col("rn")
    name = F.when(rn % 5 == 0, "Sample ID").otherwise(F.concat("p_name", F.when(rn % 3 == 1, " B12").otherwise("")))
    value = F.concat(F.when(rn % 4 == 2, "<").otherwise(""), F.col("l_quantity").cast("int").cast("string"))
    line = F.concat_ws(" ", name, value, F.concat(F.col("lo").cast("string"), F.lit(" - "), F.col("hi").cast("string")), F.when(F.col("unit") != "%", F.col("unit")))
    piped = F.concat_ws(" | ", name, value, F.concat(F.col("lo").cast("string"), F.lit(" - "), F.col("hi").cast("string")), F.when(F.col("unit") != "%", F.col("unit")))
    known = li.where("p_name like 'red %'").select("doc_id", F.upper("p_name").alias("name")).distinct()
    sections = _sections_of(li, "l_orderkey", "rn", F.when(rn % 2 == 0, piped).otherwise(line), "CBC")
    return facts.cell_count_rows(sections, known).select("doc_id", "name", "value_raw", "value_num", "unit", "reference_range")


@query(f"WITH {ITEMS_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'Sagittal diameter L' || rn || '-' || (rn + 1) AS name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value_raw FROM items")
def level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of levels and a row of millimetres, read as one measurement for each level."""
    li = synth.items(spark, sf_dir)
    part = lambda c: F.array_join(F.sort_array(F.collect_list(F.struct("rn", c.alias("t"))))["t"], " | ")
    rn = F.col("rn").cast("string")
    text = li.groupBy("doc_id").agg(part(F.concat(F.lit("L"), rn, F.lit("-"), (F.col("rn") + 1).cast("string"))).alias("a"), part(F.col("l_quantity").cast("int").cast("string")).alias("b"))
    sections = text.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("section_no"), F.lit("MRI").alias("title"), F.concat(F.lit("Level | "), F.col("a"), F.lit("\nsee below\nmm | "), F.col("b")).alias("text"))
    return facts.level_measurements(sections).select("doc_id", "name", "value_raw")


@query(f"""WITH {ITEMS_SQL}, i AS (SELECT l_orderkey AS d, rn % 6 AS r, CAST(l_quantity AS INTEGER) AS q, p_name, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS big, string_split(p_name, ' ') AS w,
  CASE WHEN w[1] IN ('small', 'large') THEN upper(substr(w[2], 1, 1)) || substr(w[2], 2) ELSE big END AS thing FROM items),
n AS (SELECT d, CASE r WHEN 0 THEN thing WHEN 1 THEN 'Large ' || upper(substr(w[1], 1, 1)) || substr(w[1], 2) || ' ' || upper(substr(w[2], 1, 1)) || substr(w[2], 2) WHEN 2 THEN CASE WHEN thing = big THEN big ELSE w[2] END || ' Volume' WHEN 4 THEN 'Cyst' ELSE 'Measurement' END AS name,
  CASE r WHEN 4 THEN q + 1 ELSE q END AS v, CASE r WHEN 0 THEN 'cm' WHEN 2 THEN 'cc' WHEN 4 THEN 'cm' ELSE 'mm' END AS unit FROM i WHERE r < 5
  UNION ALL SELECT d, thing, q + 2, 'mm' FROM i WHERE r = 0)
SELECT DISTINCT CAST(d AS VARCHAR) AS doc_id, name, CAST(v AS VARCHAR) AS value_raw, unit FROM n""")
def sized_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in narrative lines: by subject (two in a line), by the words before them, volumes, without any name, by an organ word; a
    table line has none."""
    q, rn = F.col("l_quantity").cast("int"), F.col("rn") % 6
    big = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    line = (F.when(rn == 0, text(big, ": is enlarged (~", q, "cm), wall ", q + 2, " mm thick.")).when(rn == 1, text("A large ", F.col("p_name"), " measuring ~", q, "mm is there"))
            .when(rn == 2, text("**", big, ":** normal (Vol~", q, "cc), shape")).when(rn == 3, text("Seen 3 x", q, " times, ", q, " mm off")).when(rn == 4, text("Small cyst near, ", q, " x ", q + 1, " cm")).otherwise(text("| row | ", q, " mm |")))
    return facts.sized_objects(_sections_of(synth.items(spark, sf_dir), "l_orderkey", "rn", line, "Impression")).select("doc_id", "name", "value_raw", "unit")


@query("""WITH n AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT 'Serum ' || p_name || ' level' AS name, CASE WHEN a = 'hot' THEN NULL WHEN a = 'red' THEN 'X-' || p_name ELSE 'N-' || b END AS code FROM n""")
def code_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to codes by the longest alias that stands in them; an alias without a code (hot things) stops the search."""
    names = base._names(spark, sf_dir)
    by_noun = names.select(F.col("noun").alias("alias"), F.concat(F.lit("N-"), F.col("noun")).alias("code")).distinct()
    by_name = names.where("adjective in ('red', 'hot')").select(F.col("p_name").alias("alias"), F.when(F.col("adjective") == "red", F.concat(F.lit("X-"), F.col("p_name"))).alias("code"))
    return ranges.resolve_codes(names.select(F.concat(F.lit("Serum "), F.col("p_name"), F.lit(" level")).alias("name")), by_noun.unionByName(by_name))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 8 IN (0, 2, 4) THEN 'female' WHEN o_orderkey % 8 IN (1, 3, 5) THEN 'male' END AS gender FROM orders")
def patient_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sex from a field, else from words of the header, else null."""
    heads = ["Sex: F", "Age: 28 years, Male", "A girl of nine, seen by Mr Doe", "34/M", "F/61", "gender - boy", "Mrs Doe, referred", "no header"]
    said = F.element_at(F.array(*map(F.lit, heads)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    sections = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("section_no"), F.lit("Header").alias("title"), said.alias("text"))
    return ranges.patient_sex(sections)


@query(f"""WITH {ITEMS_SQL}, i AS (SELECT * FROM items JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT DISTINCT l_orderkey, lead, p_name FROM i), a AS (SELECT DISTINCT l_orderkey, p_name FROM i),
x AS (SELECT l_orderkey, 'FINDING' AS type FROM f UNION ALL SELECT l_orderkey, 'ANATOMY' FROM a UNION ALL SELECT l_orderkey, 'MEASUREMENT' FROM a)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, type, count(*) AS n FROM x GROUP BY 1, 2""")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of findings, anatomy and measurements, one for a text, type and page."""
    pages = base.kept(synth.reports(spark, sf_dir), "pages")
    sections = base.kept(layout.sections_markdown(pages), "sections")
    lexicon = base._names(spark, sf_dir).select(F.lit("generic").alias("rule_set"), F.row_number().over(Window.orderBy("p_name")).alias("position"), F.col("p_name").alias("pattern"))
    terms_ = facts.anatomy(sections, sections.select("doc_id").distinct().withColumn("rule_set", F.lit("generic")), lexicon)
    found = facts.inline_measurements(sections, base.parsed_measurements(spark, sf_dir, pages))
    return facts.entities(base._findings(spark, sf_dir, sections), terms_, found).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'Mild' ELSE 'Severe' END AS severity, CASE p_size % 4 WHEN 0 THEN 'Grade 1' WHEN 1 THEN 'Grade 2' WHEN 2 THEN 'Grade 3' ELSE 'Grade 4' END AS grade,
  CASE WHEN p_size % 3 = 0 THEN 'Concentric' END AS pattern, CASE WHEN p_size % 5 = 0 THEN 'EFFUSION' WHEN p_size % 3 = 0 THEN 'STRUCTURAL_FINDING' ELSE 'OTHER_CLINICAL' END AS category FROM part""")
def finding_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, grade, pattern and category of finding texts."""
    size = F.col("p_size")
    text = F.concat_ws(" ", F.when(size % 2 == 0, "mild").otherwise("severe"), F.when(size % 3 == 0, "conc LVH"), F.lit("grade"), F.element_at(F.array(F.lit("i"), F.lit("II"), F.lit("iii"), F.lit("IV")), size % 4 + 1), F.when(size % 5 == 0, "effusion"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), text.alias("t")).withColumn("m", facts.modifiers(F.col("t")))
    return rows.select("doc_id", F.col("m")["severity_text"].alias("severity"), F.col("m")["grade_text"].alias("grade"), F.col("m")["pattern"].alias("pattern"), facts.category(F.col("t"), facts.FINDING_CATEGORIES, "OTHER_CLINICAL").alias("category"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, list_sort(list_distinct([split_part(p_name, ' ', 2) || ' part', p_name])) AS related FROM part""")
def related_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation targets and the document's own anatomy words of a source."""
    nouns = base._names(spark, sf_dir).select("noun").distinct()
    links = nouns.select(F.row_number().over(Window.orderBy("noun")).alias("position"), F.col("noun").alias("key"), F.concat("noun", F.lit(" part")).alias("target"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_name").alias("source"))
    words = part.select("doc_id", F.col("source").alias("term"))
    out = facts.related_anatomy(part, facts.relationships(part, links, "ASSOCIATED_WITH"), words)
    return out.select("doc_id", F.array_sort("related").alias("related"))


@query("""WITH v AS (SELECT p_type, split_part(p_name, ' ', 2) AS noun FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2)
SELECT count(*) AS n, count(v.noun) AS covered, round(count(v.noun) / count(*), 4) AS share FROM part p LEFT JOIN v ON v.p_type = p.p_type AND v.noun = split_part(p_name, ' ', 2)""")
def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coverage(base.QUERIES["terms_exact"](spark, sf_dir))


@query("""WITH d AS (SELECT DISTINCT p_brand, p_name, p_size % 2 AS o FROM part), s AS (SELECT *, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 1 WHEN 'bolt' THEN 2 ELSE 8 END AS k FROM d)
SELECT p_brand AS doc_id, CAST(count(*) + 2 * count(DISTINCT k) - 1 AS INTEGER) AS n_lines FROM s GROUP BY 1""")
def explanation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations rendered as Markdown, counted in lines."""
    names = spark.createDataFrame([("RING", "Rings", 1), ("BOLT", "Bolts", 2)], "semantic_category string, section_title string, section_order int")
    text = report.markdown(report.sectioned(base._part_explained(spark, sf_dir), names))
    return text.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))


@query("""SELECT lower(w) AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['urgent'] WHEN 1 THEN ['Diagnosis', 'cancer'] ELSE [] END) AS w FROM documents) GROUP BY 1""")
def forbidden_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of explanations for words that they must not use."""
    r = F.col("doc_id") % 3
    text = F.when(r == 0, "This is urgent.").when(r == 1, "Diagnosis: cancerous? no, cancer").otherwise("All is well.")
    return evaluate.forbidden_words(table(spark, sf_dir, "documents").select("doc_id", text.alias("explanation")))


@query(f"""WITH {ITEMS_SQL}, i AS (SELECT DISTINCT l_orderkey, lead, p_name FROM items JOIN orders ON l_orderkey = o_orderkey)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, p_name AS term, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN NULL ELSE upper(p_name) END AS normalized, count(*) AS n FROM i GROUP BY ALL""")
def resolved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the resolution of their pattern merged in; an ambiguous one (here: red things) gets no name."""
    found = base.kept(base._findings(spark, sf_dir), "found")
    res = found.select("doc_id", F.col("pattern").alias("term")).distinct().withColumns({"normalized": F.upper("term"), "status": F.when(F.col("term").startswith("red "), "AMBIGUOUS").otherwise("RESOLVED")})
    merged = terms.merge_into_facts(found, res, "pattern")
    return merged.groupBy("doc_id", F.col("pattern").alias("term"), "normalized").agg(F.count("*").alias("n"))


_NOTE_WORDS = "WITH i AS (SELECT l_orderkey AS d, l_linenumber AS k, l_quantity AS v, 'cough' || l_linestatus AS w FROM lineitem)"


@query(f"""{_NOTE_WORDS} SELECT DISTINCT CAST(d AS VARCHAR) AS doc_id, CASE v % 4 WHEN 0 THEN 'denies ' ELSE 'Age related ' END || w AS finding, CASE v % 4 WHEN 0 THEN 'ABSENT' ELSE 'PRESENT' END AS assertion FROM i WHERE v % 4 IN (0, 1)""")
def note_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as lines of notes: findings, also in lines that begin like a field; fields and vitals give none."""
    v, w = F.col("l_quantity") % 4, F.concat(F.lit("cough"), "l_linestatus")
    line = F.when(v == 0, F.concat(F.lit("- denies "), w)).when(v == 1, F.concat(F.lit("Age related "), w)).when(v == 2, F.concat(F.lit("Age: "), w)).otherwise(F.concat(F.lit("Vitals: BP 120/80 "), w))
    li = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    sections = _sections_of(li, "l_orderkey", "o", line, "Note")
    modes = table(spark, sf_dir, "lineitem").select(F.lit("general_note").alias("rule_set"), F.xxhash64(w).alias("position"), w.alias("pattern")).distinct()
    routed = facts.route(sections.select("doc_id", F.lit("General").alias("report_type")), dims.rule_aliases(spark))
    return facts.findings(facts.note_clauses(sections), routed, modes, gated=False).select("doc_id", "finding", "assertion")


@query("""WITH m AS (SELECT l_orderkey AS d, l_returnflag || ' size' AS name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS v FROM lineitem WHERE l_linestatus = 'F' UNION SELECT l_orderkey, l_returnflag || ' size', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber % 3 <> 0)
SELECT CAST(d AS VARCHAR) AS doc_id, name, v AS value_raw, CAST(NULL AS VARCHAR) AS reference_range FROM m""")
def radiology_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of text and of tables together: every third of a table is an administrative field, and none keeps a range."""
    li = table(spark, sf_dir, "lineitem").withColumn("name", F.concat("l_returnflag", F.lit(" size")))
    row = lambda df, name: df.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), name.alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value_raw"), F.lit("mm").alias("unit"))
    field = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Ref "), F.col("name"))).otherwise(F.col("name"))
    return facts.radiology_merge(row(li.where("l_linestatus = 'F'"), F.col("name")), row(li.where("l_linestatus = 'O'"), field)).select("doc_id", "name", "value_raw", "reference_range")


@query("""SELECT p_partkey AS part_no, p_name || ' x' AS cell, 'Part ' || p_name || ' of ' || p_brand AS body FROM part""")
def markup_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in Markdown and HTML, as a cell and as a body text."""
    cell = F.concat(F.lit("**"), F.col("p_name"), F.lit("** <u>x</u>"))
    body = F.concat(F.lit("# Part _"), F.col("p_name"), F.lit("_ of<br/>\n["), F.col("p_brand"), F.lit("](http://x/y)"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_no"), strip_markup(cell).alias("cell"), strip_markup(body, "text").alias("body"))


@query("""WITH s AS (SELECT o_orderkey AS d, o_orderkey % 3 AS r, o_orderpriority AS p FROM orders) SELECT CAST(d AS VARCHAR) AS doc_id, CASE r WHEN 0 THEN p || ' report' ELSE 'Results' END AS title FROM s WHERE r <> 2""")
def title_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section title that is no patient header."""
    r = F.col("o_orderkey") % 3
    first, second = F.concat("o_orderpriority", F.lit(" report")), F.lit("Results")
    titles = F.array(F.when(r == 0, first).when(r == 1, F.lit("Patient name")).otherwise(F.lit("12")), F.when(r == 2, F.lit("Date of visit")).otherwise(second))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.posexplode(titles).alias("k", "title"))
    return classify.document_titles(rows.select("doc_id", F.lit(1).alias("page"), (F.col("k") + 1).alias("section_no"), "title", F.lit("").alias("text")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN o_orderstatus = 'O' THEN 'lipid_profile' WHEN o_orderpriority LIKE '%URGENT%' THEN 'echocardiography' ELSE 'unknown' END AS report_type FROM orders""")
def type_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown documents with a marker word become echo reports; ambiguous and known ones stay."""
    o = table(spark, sf_dir, "orders")
    known = F.when(F.col("o_orderstatus") == "O", "CONFIDENT").when(F.col("o_orderstatus") == "P", "AMBIGUOUS").otherwise("UNKNOWN")
    docs = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.when(known == "CONFIDENT", "lipid_profile").otherwise("unknown").alias("report_type"), known.alias("status"))
    texts = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.when(F.col("o_orderpriority").contains("URGENT"), "Conc LVH seen").otherwise("nothing").alias("text"))
    return classify.fallback_type(docs, texts, r"(?i)\b(lvh|rwma|lvdd)\b", "echocardiography").select("doc_id", "report_type")


@query("""SELECT p_partkey AS part_no, CASE p_size % 4 WHEN 0 THEN 'Mild ' || p_name WHEN 1 THEN 'Grade 2 ' || p_name WHEN 2 THEN p_name END AS normalized, CASE WHEN p_size % 4 = 3 THEN 'NOT_APPLICABLE' ELSE 'RESOLVED' END AS status FROM part""")
def terms_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as terms with a qualifier, with curly quotes, and units, which are no terms."""
    size, name = F.col("p_size") % 4, F.col("p_name")
    term = F.when(size == 0, F.concat(F.lit("mild "), name)).when(size == 1, F.concat(F.lit("grade ii *"), name, F.lit("*"))).when(size == 2, name).otherwise(F.lit("mmHg"))
    corpus = base._names(spark, sf_dir).select(F.col("p_name").alias("surface_form"), F.col("p_name").alias("candidate"), F.lit("general").alias("domain"), F.lit(False).alias("is_safety"), F.lit(1).alias("line_no"), F.lit(False).alias("ambiguous"))
    corpus = terms.tagged_candidates(corpus, spark.createDataFrame([], "term string, domain string"), spark.createDataFrame([("cardiology", "ventricle")], "domain string, keyword string"))
    return terms.resolve(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_no"), term.alias("term")), corpus).select("part_no", "normalized", "status")


@query(f"""WITH {ITEMS_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber AS BIGINT) AS line_no, CASE WHEN l_quantity < lo THEN 'LOW' WHEN l_quantity > hi THEN 'HIGH' ELSE 'NORMAL' END AS side, count(*) AS n FROM items GROUP BY ALL""")
def range_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side of each item's quantity by the numbers of its range text."""
    li = synth.items(spark, sf_dir)
    side = report.range_side(F.col("l_quantity").cast("double"), F.concat(F.lit("("), F.col("lo").cast("string"), F.lit(" to "), F.col("hi").cast("string"), F.lit(")")))
    return li.groupBy("doc_id", F.col("l_linenumber").cast("long").alias("line_no"), side.alias("side")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT lower(event_type) AS key FROM events WHERE event_type <> (SELECT min(event_type) FROM events)""")
def terms_not_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as terms; the first in order has been looked up before."""
    from medtab.streaming import intake

    ev = table(spark, sf_dir, "events")
    return intake.new_terms(ev.select(F.concat(F.lit(" "), F.upper("event_type")).alias("term")), ev.agg(F.min("event_type").alias("key")))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS d, l_suppkey % 7 AS k FROM lineitem), r(rule, k) AS (VALUES ('left_ventricular_systolic_function_cluster', 0), ('left_ventricular_systolic_function_cluster', 1),
  ('thyroid_function_cluster', 2), ('thyroid_function_cluster', 3), ('lipid_panel_cluster', 4), ('metabolic_syndrome_cluster', 4), ('lipid_panel_cluster', 5), ('metabolic_syndrome_cluster', 6), ('glycemic_screening_cluster', 6))
SELECT CAST(d AS VARCHAR) AS doc_id, rule, CAST(count(*) AS INTEGER) AS n FROM c JOIN r USING (k) GROUP BY 1, 2 HAVING count(*) >= 2""")
def context_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of an order that belong together by the rules at hand."""
    said = F.array(*map(F.lit, ["Ejection Fraction", "fractional shortening", "TSH level", "Free T4", "Serum Triglycerides", "HDL value", "Fasting Glucose"]))
    concepts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.element_at(said, (F.col("l_suppkey") % 7 + 1).cast("int")).alias("concept"))
    return ranges.context_groups(concepts, dims.context_rules(spark)).select("doc_id", "rule", F.size("concepts").alias("n"))


@query("""WITH i AS (SELECT l_orderkey AS d, l_linestatus AS s, CAST(l_quantity AS INTEGER) % 2 = 0 AS even FROM lineitem),
c AS (SELECT d, unnest(CASE WHEN even THEN ['Mitral valve:   leak' || s || ' seen, wide', 'No mass' || s, 'No clot' || s || ', soft edge', 'mild fold', 'No gap, 5 mm', 'AORTIC VALVE: Normal', 'AORTIC VALVE : leak' || s, 'TRICUSPID VALVE: Thin. Opening well. No prolapse', 'Opening well', 'No prolapse']
    ELSE ['Mitral valve:   leak' || s || ' seen, wide', 'No mass' || s, 'No clot' || s || ', soft edge', 'No gap, 5 mm', 'AORTIC VALVE: Normal', 'AORTIC VALVE : leak' || s, 'TRICUSPID VALVE: Thin. Opening well. No prolapse', 'Opening well', 'No prolapse'] END) AS clause FROM i)
SELECT DISTINCT CAST(d AS VARCHAR) AS doc_id, CASE WHEN clause = 'mild fold' THEN 'mild leak fold' ELSE clause END AS clause, CASE WHEN clause LIKE 'No %' OR clause LIKE 'TRICUSPID%' THEN 'ABSENT' WHEN clause LIKE '%Normal' OR clause = 'Opening well' THEN 'NORMAL' ELSE 'PRESENT' END AS assertion FROM c""")
def echo_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of an echo report: findings without any stop between them ("No mass No clot"), commas that part findings
    and others that don't, valves that say something short or more, numbers, a table line."""
    li = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    s = F.col("l_linestatus")
    text = F.concat(F.lit("- **Mitral valve:** leak"), s, F.lit(" seen, wide No mass"), s, F.lit(" No clot"), s, F.lit(", soft edge; EF: 60%\n| No | leak |\nplain words"), F.when(F.col("l_quantity") % 2 == 0, ", mild leak fold").otherwise(""),
                    F.lit(". No gap, 5 mm\nAORTIC VALVE : Normal TRICUSPID VALVE: Thin. Opening well. No prolapse\nAORTIC VALVE : leak"), s, F.lit(" PASP=34mmHg"))
    return facts.echo_clauses(_sections_of(li, "l_orderkey", "o", text, "Findings"), r"(?i)\bleak").select("doc_id", "clause", "assertion")


@query("""SELECT p_brand AS doc_id, 'Report type: order (confident), abnormal: ' || count(*) FILTER (p_size % 2 = 0) AS head, CAST(count(*) + 4 AS INTEGER) AS n_lines FROM part GROUP BY 1""")
def plain_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a brand as the findings of one report, summed up in plain text."""
    concepts = base._part_concepts(spark, sf_dir).withColumn("reference_range", F.lit(None).cast("string"))
    classified = concepts.select("doc_id", F.lit("order").alias("report_type"), F.lit("CONFIDENT").alias("status"), F.lit(1.0).alias("confidence")).distinct()
    summaries = report.plain_summary(report.final_reports(classified, concepts, ranges.significance(concepts))).withColumn("lines", F.split("text", "\n"))
    return summaries.select("doc_id", F.col("lines")[0].alias("head"), F.size("lines").alias("n_lines"))


@query("""SELECT p_partkey AS part_no, CASE p_size % 4 WHEN 0 THEN split_part(p_name, ' ', 2) || ' stuff' WHEN 3 THEN 'Zed of all' END AS normalized, CASE p_size % 4 WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'UNKNOWN' ELSE 'RESOLVED' END AS status,
  CASE WHEN p_size % 4 < 2 THEN 'terminology_corpus' WHEN p_size % 4 = 3 THEN 'universal_dictionary' END AS source, p_size % 4 < 2 AS is_safety FROM part""")
def terms_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety forms, which need a larger lead, and what only the universal vocabulary knows."""
    size, noun = F.col("p_size") % 4, F.element_at(F.split("p_name", " "), 2)
    nouns = base._names(spark, sf_dir).select("noun").distinct()
    corpus = nouns.select(F.col("noun").alias("surface_form"), F.concat("noun", F.lit(" stuff")).alias("candidate"), F.lit("general").alias("domain"), F.lit(True).alias("is_safety"), F.lit(1).alias("line_no"), F.lit(False).alias("ambiguous"))
    corpus = terms.tagged_candidates(corpus, spark.createDataFrame([], "term string, domain string"), spark.createDataFrame([("cardiology", "ventricle")], "domain string, keyword string"))
    said = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_no"), F.when(size < 2, noun).when(size == 2, F.lit("nothing here")).otherwise(F.lit("ZED")).alias("term"),
                                               F.when(size == 0, F.concat(noun, F.lit(" stuff"))).otherwise(F.lit("stuff")).alias("source_text"))
    return terms.resolve(said, corpus, universal=spark.createDataFrame([("Zed", "Zed of all")], "key string, value string")).select("part_no", "normalized", "status", "source", "is_safety")


@query("""SELECT event_type, user_id % 4 <> 1 AS is_date, count(*) AS n FROM events GROUP BY ALL""")
def date_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as measurements three of four of which are dates: by the field, by a month, by the rest of a date."""
    r = F.col("user_id") % 4
    name = F.when(r == 0, "Registered").when(r == 1, "Size").when(r == 2, "12 Mar").otherwise("Dose")
    unit = F.when(r == 1, "mm").when(r == 3, "/12/2020")
    flag = facts.is_date(name, F.when(r == 3, "7").otherwise("12"), unit)
    return table(spark, sf_dir, "events").groupBy("event_type", flag.alias("is_date")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'Results' AS title FROM orders WHERE o_orderkey % 3 = 2""")
def skipped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose titles say that they hold no facts are left out."""
    r = F.col("o_orderkey") % 3
    title = F.when(r == 0, "Interpretation of values").when(r == 1, " COMMENTS").otherwise("Results")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), title.alias("title"))
    return facts.skip_sections(rows, ["interpretation"], ["comments"])


@query("""SELECT p_partkey AS part_no, p_size % 4 = 0 AS short_enough FROM part""")
def finding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that may be a finding: not too long, no row of a table, no number first."""
    size, name = F.col("p_size") % 4, F.col("p_name")
    text = F.when(size == 0, name).when(size == 1, F.array_join(F.array_repeat(name, 6), " ")).when(size == 2, F.concat(F.lit("3 "), name)).otherwise(F.concat(name, F.lit(" | x")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_no"), facts.is_finding_text(text).alias("short_enough"))


@query(f"""WITH {ITEMS_SQL}, q AS (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS v FROM items)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'Value ' || v || ' ' || unit || ' is ' || CASE WHEN l_quantity < lo THEN 'below' WHEN l_quantity > hi THEN 'above' ELSE 'within' END || ' the reported reference range ' || lo || '–' || hi || ' ' || unit AS basis,
  'reported' AS range_source, count(*) AS n FROM q GROUP BY ALL""")
def range_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each comparison of an order's items rests on, in words."""
    li = synth.items(spark, sf_dir)
    span = F.concat(F.col("lo").cast("string"), F.lit(" - "), F.col("hi").cast("string"))
    null = F.lit(None).cast("string")
    concepts = li.select("doc_id", F.col("rn").alias("concept_no"), F.col("p_name").alias("concept"), F.col("l_quantity").cast("int").cast("string").alias("value_raw"), F.col("l_quantity").cast("double").alias("value_num"),
                         "unit", span.alias("reference_range"), null.alias("assertion"), F.create_map().cast("map<string,string>").alias("modifiers"))
    return ranges.significance(concepts).groupBy("doc_id", "basis", "range_source").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS d, o_orderkey % 3 AS r, o_orderkey % 5 AS c, o_orderkey % 60 AS v FROM orders), b AS (SELECT *, CASE r WHEN 0 THEN 10 + c WHEN 1 THEN 30 + c ELSE 0 END AS lo, CASE r WHEN 0 THEN 20 WHEN 1 THEN 45 ELSE 50 END AS hi FROM o)
SELECT CAST(d AS VARCHAR) AS doc_id, CASE WHEN v < lo THEN 'BELOW_REPORTED_REFERENCE_RANGE' WHEN v > hi THEN 'ABOVE_REPORTED_REFERENCE_RANGE' ELSE 'WITHIN_REPORTED_RANGE' END AS comparison, 'loinc_standard' AS range_source FROM b""")
def ranges_by_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without a reported range, compared with the standard range of their code and the patient's sex."""
    r, c = F.col("o_orderkey") % 3, F.col("o_orderkey") % 5
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("c"), c.cast("string")).alias("code"), (F.col("o_orderkey") % 60).cast("double").alias("value_num"),
                                                   F.when(r == 0, "Name: X, Sex: Female").when(r == 1, "Gender - M").otherwise("unsaid").alias("text"))
    sexes = ranges.patient_sex(orders.select("doc_id", F.lit(1).alias("section_no"), F.lit("Head").alias("title"), "text"))
    spans = [(f"c{k}", g, "reference", i, float(low + step * k), float(high), "mm") for k in range(5) for i, (g, low, step, high) in enumerate([("female", 10, 1, 20), ("male", 30, 1, 45), (None, 0, 0, 50)])]
    dim = spark.createDataFrame(spans, "code string, gender string, category string, interval_no int, low double, high double, unit string")
    asked = orders.join(sexes, "doc_id")
    null = F.lit(None).cast("string")
    concepts = asked.select("doc_id", F.lit(1).alias("concept_no"), F.lit("Size").alias("concept"), null.alias("value_raw"), "value_num", F.lit("mm").alias("unit"), null.alias("reference_range"), null.alias("assertion"), F.create_map().cast("map<string,string>").alias("modifiers"))
    picked = ranges.pick_ranges(asked, dim).select(F.col("code").alias("c"), F.col("gender").alias("g"), "low", "high", F.col("unit").alias("std_unit"))
    standard = asked.join(picked, (F.col("code") == F.col("c")) & F.col("gender").eqNullSafe(F.col("g"))).select("doc_id", F.lit(1).alias("concept_no"), F.col("low").alias("std_low"), F.col("high").alias("std_high"), "std_unit")
    return ranges.significance(concepts, standard, dims.unit_conversions(spark)).select("doc_id", "comparison", "range_source")


_REPORTS_SQL = f"""{ITEMS_SQL}, i AS (SELECT l_orderkey AS d, o_orderstatus AS st, o_custkey % 2 = 0 AS female, rn, p_name, p_size, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, lead, CAST(l_quantity AS INTEGER) AS q, lo, hi,
  CASE WHEN rn % 2 = 1 THEN unit WHEN p_size % 2 = 0 THEN '°F' ELSE '°C' END AS u, CASE WHEN rn % 2 = 1 THEN lo || ' - ' || hi ELSE '' END AS ref FROM items JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT DISTINCT d, st, noun, rn % 2 = 0 AS short, lead, lead || CASE WHEN rn % 2 = 1 THEN p_name ELSE noun END AS txt FROM i),
m AS (SELECT DISTINCT ON (d, p_name, q) * FROM i ORDER BY d, p_name, q, u, ref),
n AS (SELECT d, list_sort(list(DISTINCT p_name)) AS ns FROM m GROUP BY d), e AS (SELECT d, list(DISTINCT lower(txt)) AS ts FROM f GROUP BY d),
c AS (SELECT DISTINCT p_name AS c, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part),
t AS (SELECT f.d, f.st, f.txt, c.c, c.adj, c.noun, ns, ts, [x for x in ns if contains(x, c.c) OR contains(c.c, x)] AS near FROM f JOIN c ON f.short AND f.noun = c.noun JOIN n ON n.d = f.d JOIN e ON e.d = f.d),
s AS (SELECT d, txt, c, adj, CASE WHEN adj = 'red' THEN CASE WHEN st = 'F' THEN 50 ELSE -20 END WHEN adj = 'hot' THEN -20 ELSE 0 END
    + CASE WHEN contains(lower(txt), adj) THEN 20 ELSE 10 END + CASE WHEN adj = 'blue' AND len(near) > 0 THEN 15 ELSE 0 END + CASE WHEN len(near) > 0 THEN 20 ELSE 0 END
    + CASE WHEN adj = 'hot' THEN 10 * len([x for x in ns if contains(x, 'hot') AND (len(near) = 0 OR x < near[1])]) ELSE 0 END
    + CASE WHEN len(near) > 0 OR len([x for x in ts if contains(x, c)]) > 0 THEN 5 ELSE 0 END + CASE WHEN adj = 'red' THEN 4 ELSE 0 END + CASE WHEN adj = 'old' AND st = 'O' THEN 3 ELSE 0 END AS score FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY d, txt ORDER BY score DESC, c) AS place, coalesce(lead(score) OVER (PARTITION BY d, txt ORDER BY score DESC, c), -1) AS next FROM s),
z AS (SELECT * FROM k WHERE place = 1 AND score > 0 AND (score - next >= 10 OR (next <= 0 AND score >= 12))),
v AS (SELECT *, CASE WHEN ref <> '' THEN lo WHEN noun <> 'rod' THEN -10 END AS low, CASE WHEN ref <> '' THEN hi WHEN noun = 'rod' THEN NULL WHEN noun = 'ring' AND female THEN 0 ELSE 4 END AS high,
  CASE WHEN ref = '' AND noun <> 'rod' AND u = '°F' THEN (q - 32) * 5 / 9.0 ELSE q END AS w, CASE u WHEN '°F' THEN '[degF]' WHEN '°C' THEN 'Cel' ELSE u END AS cu FROM m),
mm AS (SELECT d, count(*) AS n_measurements, count(*) FILTER (w < low OR w > high) AS a, count(*) FILTER (adj <> 'old') AS x, CAST(sum(low) AS DOUBLE) AS low_sum, CAST(sum(high) AS DOUBLE) AS high_sum, round(sum(w), 2) AS converted_sum, count(*) FILTER (ref = '' AND noun <> 'rod') AS n_standard,
  min(CASE WHEN adj <> 'old' THEN p_name || ' is ' || q || ' ' || cu || ', ' || CASE WHEN ref = '' THEN 'given without a usable range' WHEN q < lo THEN 'below the reported range' WHEN q > hi THEN 'above the reported range' ELSE 'within the reported range' END || '. A kind of ' || noun END) AS said FROM v GROUP BY d),
ff AS (SELECT f.d, count(*) AS n_findings, count(*) FILTER (lead = 'Mild ') AS a, count(z.c) AS n_resolved, count(CASE WHEN z.adj <> 'old' THEN 1 END) AS x, string_agg(DISTINCT z.c, ',' ORDER BY z.c) AS resolved FROM f LEFT JOIN z ON z.d = f.d AND z.txt = f.txt GROUP BY f.d),
y AS (SELECT DISTINCT d, st FROM i)"""


def report_tables(spark: SparkSession, sf_dir: str):
    """Dimension tables of the job, made from the parts: terms that need a document's context, standards by sex, definitions."""
    from medtab.operators import job

    names = base._names(spark, sf_dir)
    place = lambda by: F.row_number().over(Window.orderBy(by))
    nouns = names.select("noun").distinct()
    lexicon = names.select(F.lit("generic").alias("rule_set"), place("p_name").alias("position"), F.col("p_name").alias("pattern")).unionByName(nouns.select(F.lit("generic").alias("rule_set"), (place("noun") + 1000).alias("position"), F.col("noun").alias("pattern")))
    forms = names.select(F.col("noun").alias("surface_form"), F.col("p_name").alias("candidate"), F.lit("general").alias("domain"), F.lit(False).alias("is_safety"), place("p_name").alias("line_no"), F.lit(True).alias("ambiguous"))
    domains = names.where("adjective = 'red'").select(F.col("p_name").alias("term"), F.lit("type f").alias("domain"))
    signature = [(f"type {x}", i, "title", 0, 0, f"order {x}", 0.0) for i, x in enumerate("fo")]
    standards = nouns.where("noun <> 'rod'").select(F.concat(F.lit("C-"), "noun").alias("code"), F.explode(F.when(F.col("noun") == "ring", F.array(F.lit("male"), F.lit("female"))).otherwise(F.array(F.lit(None).cast("string")))).alias("gender"))
    standards = standards.select("code", "gender", F.lit("reference").alias("category"), F.lit(0).alias("interval_no"), F.lit(-10.0).alias("low"), F.when(F.col("gender") == "female", 0.0).otherwise(4.0).alias("high"), F.lit("Cel").alias("unit"))
    return job.Tables(
        signatures=spark.createDataFrame(signature, "report_type string, registry_no int, role string, group_no int, position int, pattern string, weight double"), findings=lexicon,
        anatomy=names.where("adjective = 'blue'").select(F.lit("generic").alias("rule_set"), place("p_name").alias("position"), F.col("p_name").alias("pattern")),
        links=nouns.select(place("noun").alias("position"), F.col("noun").alias("key"), F.concat(F.lit("red "), "noun").alias("target")),
        candidates=terms.tagged_candidates(forms, domains, spark.createDataFrame([("warm", "hot")], "domain string, keyword string")),
        definitions=names.where("adjective <> 'old'").select(F.col("p_name").alias("key"), F.concat(F.lit("A kind of "), "noun").alias("definition"), F.col("noun").alias("category")),
        vocabulary=names.where("adjective = 'old'").select(F.lit("type o").alias("rule_set"), F.concat(F.lit("zzz "), "noun").alias("key"), F.col("p_name").alias("value")), rule_sets=dims.rule_aliases(spark),
        codes=nouns.where("noun <> 'rod'").select(F.col("noun").alias("alias"), F.concat(F.lit("C-"), "noun").alias("code")), standards=standards, unit_aliases=dims.unit_aliases(spark), conversions=dims.unit_conversions(spark), context=dims.context_rules(spark), header=[])


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages``: a report of each order with a head, a table (half of its rows without a range) and findings (half of them abbreviated)."""
    rn, text = F.col("rn"), lambda c: F.col(c).cast("string")
    li = synth.items(spark, sf_dir)
    odd = rn % 2 == 1
    unit = F.when(odd, F.col("unit")).when(F.col("p_size") % 2 == 0, "°F").otherwise("°C")
    row = F.concat(F.lit("| "), F.col("p_name"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), unit, F.lit(" | "), F.when(odd, F.concat(text("lo"), F.lit(" - "), text("hi"))).otherwise(""), F.lit(" |"))
    said = F.concat("lead", F.when(odd, F.col("p_name")).otherwise(F.element_at(F.split("p_name", " "), 2)))
    parts = li.groupBy("doc_id").agg(synth._joined("rn", row, "\n").alias("rows"), synth._joined("rn", said, "; ").alias("findings"))
    both = parts.join(table(spark, sf_dir, "orders"), F.col("doc_id") == text("o_orderkey"))
    page = F.concat(F.lit("# ORDER "), "o_orderstatus", F.lit(" REPORT\nSex: "), F.when(F.col("o_custkey") % 2 == 0, "female").otherwise("male"), F.lit("\n\n## "), "o_orderpriority", F.lit("\nResults of the order\n| TEST | RESULT | UNIT | REFERENCE |\n|---|---|---|---|\n"), "rows", F.lit("\n\n## FINDINGS\n"), "findings", F.lit(".\n"))
    return both.select("doc_id", F.lit(1).alias("page"), page.alias("text"), F.lit("markdown").alias("fmt"), F.lit("primary").alias("extractor"), F.lit(True).alias("success"), F.lit(0).alias("n_images"), F.array().cast("array<string>").alias("errors"))


@query(f"""WITH {_REPORTS_SQL} SELECT CAST(y.d AS VARCHAR) AS doc_id, CASE st WHEN 'F' THEN 'type f' WHEN 'O' THEN 'type o' ELSE 'unknown' END AS report_type, CASE st WHEN 'P' THEN 'UNKNOWN' ELSE 'CONFIDENT' END AS status, CAST(n_findings AS INTEGER) AS n_findings, CAST(n_measurements AS INTEGER) AS n_measurements,
  ff.a + mm.a AS n_abnormal, CAST(ff.x + mm.x AS INTEGER) AS n_explained, CAST(n_resolved AS INTEGER) AS n_resolved, coalesce(resolved, '') AS resolved, CAST(n_standard AS INTEGER) AS n_standard, coalesce(low_sum, 0) AS low_sum, coalesce(high_sum, 0) AS high_sum, converted_sum, said
FROM y JOIN mm ON mm.d = y.d JOIN ff ON ff.d = y.d""")
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job from pages to reports: types, terms resolved by the document, ranges by sex and unit, explanations."""
    from medtab.operators import job

    reports = job.full_reports(base.kept(report_pages(spark, sf_dir), "pages"), report_tables(spark, sf_dir))
    f, m = F.col("key_findings"), F.col("measurements_of_interest")
    solved = F.transform(F.filter(f, lambda x: x["concept"] != x["original_text"]), lambda x: x["concept"])
    total = lambda name: F.aggregate(m, F.lit(0.0), lambda acc, x: acc + F.coalesce(x[name], F.lit(0.0)))
    told = lambda items: F.filter(items, lambda x: x["explanation"].isNotNull())
    return reports.select("doc_id", "report_type", "status", F.size(f).alias("n_findings"), F.size(m).alias("n_measurements"), "n_abnormal", (F.size(told(f)) + F.size(told(m))).alias("n_explained"), F.size(solved).alias("n_resolved"), F.array_join(F.array_sort(F.array_distinct(solved)), ",").alias("resolved"),
                          F.size(F.filter(m, lambda x: x["range_source"] == "loinc_standard")).alias("n_standard"), total("low").alias("low_sum"), total("high").alias("high_sum"), F.round(total("converted_value"), 2).alias("converted_sum"), F.array_min(F.transform(told(m), lambda x: x["explanation"])).alias("said"))
