"""Steps whose cost must follow the rows they read: what is read once, what is broadcast, what travels."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from medtab.operators import classify, facts, job, layout, quality, ranges, report, sides
from medtab.plans import more, synth
from medtab.plans import queries as core
from medtab.sources.scratch import kept


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sections(spark, text):
    return spark.createDataFrame([("d", 1, 1, "T", text)], "doc_id string, page int, section_no int, title string, text string")


def test_a_few_words_drawn_from_a_large_table_are_broadcast(spark):
    lexicon = spark.range(2_000_000).select(F.lit("generic").alias("rule_set"), F.lit(1).alias("position"), F.when(F.col("id") % 2 == 0, "left lung").otherwise("heart").alias("pattern")).distinct()
    got = facts.anatomy(sections(spark, "The heart, the Left lung"), spark.createDataFrame([("d", "generic")], "doc_id string, rule_set string"), lexicon)
    assert "strategy=broadcast" in plan(got) and plan(got).count("Join ") == 2
    assert sorted(r["term"] for r in got.collect()) == ["Left lung", "heart"]


def test_a_cell_count_line_is_read_once(spark):
    got = facts.cell_count_rows(sections(spark, "WBC | 5.1 | 4 - 11 | mg\r\nVitamin B12 <3 2-4 % no row"))
    assert plan(got).count("[<>]{0,2}") == 1
    assert sorted(tuple(r)[3:] for r in got.collect()) == [("Vitamin B12", "<3", None, "%", "2-4"), ("WBC", "5.1", 5.1, "mg", "4 - 11")]


def test_levels_are_read_without_moving_lines(spark):
    got = facts.level_measurements(sections(spark, "Level: L1-2 L2-3 / (mm): 15.4 14.5\nLevel | L4-5 | L5-S1\nx\n\ny\nmm | *9* | 10\n"))
    assert plan(got).count("Union") == 0 and plan(got).count("Window [") == 1
    assert sorted((r["name"], r["value_raw"]) for r in got.collect()) == [(f"Sagittal diameter {a}", b) for a, b in (("L1-2", "15.4"), ("L2-3", "14.5"), ("L4-5", "9"), ("L5-S1", "10"))]


def test_a_large_table_lands_in_as_many_files_as_its_scan_has_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(core, "scratch_path", lambda session, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        core.QUERIES["stream_status"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list(Path(tmp_path / "intake" / "landing").glob("*.parquet"))) > 4


def test_an_equal_line_is_read_for_sizes_once(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(facts, "kept", lambda df, name: written.setdefault(name, kept(df, name)))
    got = facts.sized_objects(sections(spark, "Cyst: 3 cm\nCyst: 3 cm\nCyst: 4 x 5 mm\n").unionByName(sections(spark, "Cyst: 3 cm").withColumn("doc_id", F.lit("e"))))
    assert written["told"].count() == 2 and written["lines"].count() == 4
    assert sorted((r["doc_id"], r["name"], r["value_raw"], r["unit"]) for r in got.collect()) == [("d", "Cyst", "3", "cm"), ("d", "Cyst", "5", "mm"), ("e", "Cyst", "3", "cm")]


def test_items_stay_dealt_by_document(spark):
    li = synth.items(spark, "/root/testdata/sf0.001")
    physical = more._sections_of(li, "l_orderkey", "rn", F.col("p_name"), "T")._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(doc_id") == physical.count("Exchange hashpartitioning") == 1


def test_an_equal_value_is_read_once(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", None, 3), ("d", "y", 4), ("e", "z", 5)], "doc_id string, t string, n int")
    read = lambda df: df.withColumn("up", F.coalesce(F.upper("t"), F.lit("-"))).where("up <> 'Z'")
    written = {}
    monkeypatch.setattr(sides, "kept", lambda df, name: written.setdefault(name, kept(df, name)))
    want = [("a", "x", 1, "X"), ("b", "x", 2, "X"), ("c", None, 3, "-"), ("d", "y", 4, "Y")]
    got = sides.read_once(rows, ["t"], read, "t")
    assert sorted(map(tuple, got.collect())) == want and written["t"].count() == 4 and plan(got).count("upper") == 0
    monkeypatch.setattr(sides, "SMALL_BYTES", 0)
    got = sides.read_once(rows, ["t"], read, "t")  # too many to be sent: each where it stands
    assert sorted(map(tuple, got.collect())) == want and plan(got).count("Join ") == 0


def test_an_equal_table_row_is_read_once(spark, monkeypatch):
    table = "Values\n| Test | Result | Note |\n|---|---|---|\n| a | 1 % | x |\n| *a* | 2 | |\n| 1 | 3 | |\n"
    pages = spark.createDataFrame([(d, 1, table) for d in "pqr"] + [("s", 1, "| Result | Test |\n| a | 1 % | x |\n\n| q |\n|---|\n")], "doc_id string, page int, text string")
    written = {}
    monkeypatch.setattr(sides, "kept", lambda df, name: written.setdefault(name, kept(df, name)))
    got, want = layout.tables_markdown(pages, repeated=True), layout.tables_markdown(pages)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 10 and written["different"].count() == 4 and written["heads"].count() == 2


def test_evidence_is_summed_once(spark):
    found = spark.createDataFrame([("a", "t", 0, 4.0), ("a", "t", 0, 5.0), ("a", "u", 1, 3.0)], "doc_id string, report_type string, registry_no int, weight double").where("weight > 0.123")
    patterns = spark.createDataFrame([("t", 0), ("u", 1)], "report_type string, registry_no int")
    out = spark.createDataFrame([("a", "t"), ("a", "t"), ("c", "t")], "doc_id string, report_type string")
    got = classify.scores(spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string"), found, patterns, out)
    assert plan(got).count("0.123") == 1
    assert sorted(map(tuple, got.collect())) == [("a", "t", 0, 4.5, 2), ("a", "u", 1, 3.0, 1), ("b", "t", 0, 0.0, 0), ("c", "t", 0, 0.0, 0)]


def test_an_equal_name_is_cleaned_once_for_signals(spark, monkeypatch):
    pages = spark.createDataFrame([(d, 1, "# A *red* ring\n| Test | Result |\n|---|---|\n| hot bolt | 1 |\n") for d in "pq"] + [("r", 1, ""), ("t", 1, " ")], "doc_id string, page int, text string")
    rows, cut = layout.tables_markdown(pages), layout.sections_markdown(pages)
    written = {}
    monkeypatch.setattr(classify, "read_once", lambda df, keys, read, name: written.setdefault(name, sides.read_once(df, keys, read, name)))
    raw = spark.createDataFrame([("p", "never"), ("r", "bare text")], "doc_id string, text string")
    got = classify.signals(cut, rows, layout.measurements_from_tables(rows), raw)
    assert set(written) == {"titles", "brief"} and plan(written["brief"]).count("lower(") == 0
    assert [(r.signal_no, r.source_field, r.text, r.norm) for r in got.orderBy("doc_id", "signal_no").collect() if r.doc_id in "pr"] == [
        (1, "document_title", "A red ring", "a red ring"), (2, "section_title", "A red ring", "a red ring"), (3, "table_header", "Test", "test"), (4, "table_header", "Result", "result"),
        (5, "table_title", "A red ring", "a red ring"), (6, "measurement_name", "hot bolt", "hot bolt"), (7, "section_text", "| Test | Result | |---|---| | hot bolt | 1 |", "test result hot bolt 1"), (1, "raw_text", "bare text", "bare text")]


def test_counted_facts_travel_as_numbers(spark):
    rows = spark.createDataFrame([("a", 1, "Bp", "MEASUREMENT", "130/70", None, None, None, "PRESENT"), ("a", 2, "Date", "MEASUREMENT", "3", 3.0, None, None, "PRESENT"), ("a", 3, "mild pain", "FINDING", None, None, None, None, "PRESENT")],
                                 "doc_id string, concept_no int, concept string, type string, value_raw string, value_num double, unit string, reference_range string, assertion string")
    facts_ = report.reportable(ranges.significance(rows, whole=True))
    kinds = spark.createDataFrame([("a", "order", "CONFIDENT", 1.0)], "doc_id string, report_type string, status string, confidence double")
    some, every = report.assembled(kinds, facts_, fields=["concept_no", "part_no"]), report.assembled(kinds, ranges.significance(rows, whole=True))
    count = lambda df: [tuple(r) for r in df.selectExpr("size(key_findings)", "size(measurements_of_interest)", "n_abnormal", "n_concepts").collect()]
    assert count(some) == count(every) == [(1, 2, 2, 2)] and "basis" not in plan(some) and "basis" in plan(every)


def test_a_place_is_looked_for_by_an_expression_only_where_it_must(spark):
    lexicon = spark.createDataFrame([("generic", 1, "left lung"), ("generic", 2, "heart"), ("generic", 3, "ear"), ("generic", 4, "d\u00fcnn")], "rule_set string, position int, pattern string")
    rows = sections(spark, "Heart: left  lung, Left lung. Hearing, near, ear").unionByName(sections(spark, "hearty D\u00dcNN heart").withColumn("doc_id", F.lit("e")))
    got = facts.anatomy(rows, spark.createDataFrame([("d", "generic"), ("e", "generic")], "doc_id string, rule_set string"), lexicon)
    assert "instr(low" in plan(got)
    assert sorted((r.doc_id, r.term) for r in got.collect()) == [("d", "Heart"), ("d", "Left lung"), ("d", "ear"), ("e", "D\u00dcNN"), ("e", "heart")]


def test_the_job_reads_equal_rows_once(spark, monkeypatch):
    asked = []
    real = layout.tables_markdown
    monkeypatch.setattr(layout, "tables_markdown", lambda pages, **how: asked.append(how) or real(pages, **how))
    _, rows = job.parsed(spark.createDataFrame([("a", 1, "| Test | Result |\n|---|---|\n| x | 1 |")], "doc_id string, page int, text string"))
    assert asked == [{"repeated": True}] and [(r.name, r.value) for r in rows.collect()] == [("x", "1")]


def test_cells_are_counted_once_for_the_gate(spark):
    rows = spark.createDataFrame([("| a | b |\n| c | d |\n|---|---|\n| e |",), ("| a |\n| b | c |",), ("plain",)], "text string")
    got = rows.select(quality.table_coherence(F.split("text", "\n")).alias("s"))
    assert plan(got).count(r"^\|+|\|+$") == 1
    assert [r.s for r in got.collect()] == [0.7, 0.7, 1.0]
