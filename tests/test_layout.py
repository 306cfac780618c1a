from __future__ import annotations

from pyspark.sql import functions as F

from medtab import schemas
from medtab.operators import layout


def pages(spark, *texts, fmt="markdown"):
    return spark.createDataFrame([("d", i + 1, t, fmt, "primary", True, 0, []) for i, t in enumerate(texts)], schemas.PAGES)


def test_sections_markdown_restart_on_each_page(spark):
    out = layout.sections_markdown(pages(spark, "intro\n# One\nbody\n\nmore", "## Two\n\n", "tail")).orderBy("section_no").collect()
    assert [(r.page, r.section_no, r.title, r.text) for r in out] == [(1, 1, None, "intro"), (1, 2, "One", "body\n\nmore"), (2, 3, "Two", ""), (3, 4, None, "tail")]


def test_sections_plain_take_capitals_and_drop_colons(spark):
    out = layout.sections_plain(pages(spark, "HEAD\nFINDINGS:\nliver is fine\nOK\nIMPRESSION\nnone", fmt="plain")).orderBy("section_no").collect()
    assert [(r.title, r.text) for r in out] == [(None, "HEAD"), ("FINDINGS", "liver is fine\nOK"), ("IMPRESSION", "none")]


def test_table_columns_by_header_words_and_extra(spark):
    text = "Lipids\n| Test | Result | Units | Reference range | Method |\n|---|---|---|---|---|\n| **HDL** | 60 % | | 40-80 | enz |\n| | 5 | mg | | |\nend"
    rows = layout.tables_markdown(pages(spark, text)).orderBy("row_no").collect()
    assert rows[0].title == "Lipids" and rows[0].extra == {"Method": "enz"}
    assert (rows[0].name, rows[0].value, rows[0].unit, rows[0].reference_range) == ("HDL", "60 %", None, "40-80")
    m = layout.measurements_from_tables(layout.tables_markdown(pages(spark, text))).collect()
    assert [(x.name, x.value, x.unit) for x in m] == [("HDL", "60", "%")]


def test_separator_quirk_takes_row_with_blank_first_cell(spark):
    text = "| Test | Result |\n|---|---|\n| | 5 |\n| a | 6 |"
    assert layout.tables_markdown(pages(spark, text)).count() == 1
    assert layout.tables_markdown(pages(spark, text), strict_parity=False).count() == 2


def test_blank_header_becomes_value(spark):
    rows = layout.tables_markdown(pages(spark, "| Parameter | | Normal values |\n|---|---|---|\n| IVSd | 11 mm | 6-11 |")).collect()
    assert (rows[0].name, rows[0].value, rows[0].reference_range) == ("IVSd", "11 mm", "6-11")


def test_single_pipe_line_is_no_table(spark):
    assert layout.tables_markdown(pages(spark, "| a | b |\ntext")).count() == 0


def test_plain_tables_drop_empty_cells(spark):
    rows = layout.tables_plain(pages(spark, "Panel\nTest | Result | Unit\nHb | 13 | g/dL", fmt="plain")).collect()
    assert (rows[0].name, rows[0].value, rows[0].unit, rows[0].title) == ("Hb", "13", "g/dL", "Panel")


def test_lines_from_word_boxes(spark):
    words = spark.createDataFrame([("d", 1, i, float(x), float(y), float(x + 10), float(y + 8), t) for i, (x, y, t) in enumerate([(50, 0, "b"), (0, 1, "a"), (100, 0.5, "c"), (0, 20, "z")])], schemas.WORDS)
    out = layout.rebuild_lines(words).orderBy("line_no").collect()
    assert [r.line for r in out] == ["a | b | c", "z"]


def test_inspect_routes(spark):
    p = spark.createDataFrame([("a", 1, "x" * 40, 0), ("b", 1, "", 2), ("c", 1, None, 0)], "doc_id string, page int, text string, n_images int")
    assert {r.doc_id: r.source_type for r in layout.inspect(p).collect()} == {"a": "digital", "b": "scanned", "c": "unknown"}


def test_extractor_choice(spark):
    rows = [("a", "one", 1, True, "GOOD", 1, 2, []), ("a", "two", 2, True, "GOOD", 0, 0, []), ("b", "one", 1, True, "GOOD", 1, 0, []), ("b", "two", 2, True, "GOOD", 0, 0, []),
            ("c", "one", 1, False, None, 0, 0, ["x"]), ("c", "two", 2, False, None, 0, 0, ["y"]), ("d", "one", 1, True, "DEGRADED", 0, 0, []), ("d", "two", 2, False, None, 0, 0, ["z"])]
    c = spark.createDataFrame(rows, "doc_id string, extractor string, priority int, success boolean, status string, n_tables int, n_measurements int, errors array<string>")
    got = {r.doc_id: (r.extractor, r.status, r.errors) for r in layout.select_extractor(c).collect()}
    assert got == {"a": ("one", "GOOD", []), "b": ("two", "GOOD", []), "c": (None, "FAILED", ["x", "y"]), "d": (None, "FAILED", ["z"])}


def test_assemble_orders_pages(spark):
    text = layout.assemble(pages(spark, "one", "two").orderBy(F.desc("page"))).first().text
    assert text == "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo"


def test_row_order_and_partitions_do_not_matter(spark):
    base = pages(spark, "intro\n# One\n| Test | Result |\n|---|---|\n| a | 1 |\n| b | 2 |", "# Two\ntext")
    a = sorted(map(str, layout.tables_markdown(base).collect()))
    b = sorted(map(str, layout.tables_markdown(base.orderBy(F.desc("page")).repartition(3)).collect()))
    assert a == b


def test_tables_are_cut_out_without_windows_over_lines(spark):
    rows = layout.measurements_from_tables(layout.tables_markdown(pages(spark, "| Test | Result |\n|---|---|\n| a | 1 |")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan
    text = "Panel\nTest | Result\nHb | 13\n \n\x1fTest | Result\r\nHct | 40\nalone | x\n　\nend"
    got = [(r.table_no, r.row_no, r.title, r.name, r.value) for r in layout.tables_plain(pages(spark, text)).orderBy("table_no", "row_no").collect()]
    assert got == [(1, 1, "Panel", "Hb", "13"), (2, 1, "Panel", "Hct", "40"), (2, 2, "Panel", "alone", "x")]
