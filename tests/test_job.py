"""The job from pages to reports: its results on a few documents, and what its plans may move."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from medtab import dims
from medtab.operators import job, ranges, terms
from medtab.sources.scratch import kept

PAGES = "doc_id string, page int, text string"
ECHO = "# ECHO REPORT\nSex: male\n\n## Values\nChamber values\n| TEST | RESULT | UNIT | REFERENCE |\n|---|---|---|---|\n| EF | 60 | % | 55 - 70 |\n| Temperature | 104 | °F |  |\n| Reg. no. | 12 |  |  |\n\n## Findings\nMild MR. No clot; LA is normal. Mitral valve with MR.\n"


@pytest.fixture(scope="module")
def tables(spark):
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    forms = one([("mr", "Mitral Regurgitation", "cardiovascular", False, 1, True), ("mr", "Medical Record", "administration", False, 2, True)], "surface_form string, candidate string, domain string, is_safety boolean, line_no int, ambiguous boolean")
    return job.Tables(
        signatures=one([("echocardiography", 0, "title", 0, 0, "echo report", 0.0)], "report_type string, registry_no int, role string, group_no int, position int, pattern string, weight double"),
        findings=one([("echocardiography", 1, "mr"), ("echocardiography", 2, "clot"), ("echocardiography", 3, "la"), ("generic", 1, "pain")], "rule_set string, position int, pattern string"),
        anatomy=one([("echocardiography", 1, "mitral valve"), ("echocardiography", 2, "la")], "rule_set string, position int, pattern string"), links=one([(1, "la", "left atrium"), (2, "mitral", "mitral valve")], "position int, key string, target string"),
        candidates=kept(terms.tagged_candidates(forms, one([("mitral regurgitation", "cardiovascular")], "term string, domain string"), one([("cardiovascular", "mitral"), ("administration", "record")], "domain string, keyword string")), "candidates"),
        definitions=one([("Mitral Regurgitation", "Blood flows back.", "VALVULAR_FINDING"), ("EF", "Share of blood pumped.", "FUNCTION")], "key string, definition string, category string"), rule_sets=dims.rule_aliases(spark),
        codes=one([("temperature", "T")], "alias string, code string"), standards=one([("T", "male", "reference", 0, 36.0, 37.5, "Cel"), ("T", "female", "reference", 1, 36.0, 37.0, "Cel")], "code string, gender string, category string, interval_no int, low double, high double, unit string"),
        unit_aliases=dims.unit_aliases(spark), conversions=dims.unit_conversions(spark), context=dims.context_rules(spark))


def test_reports_of_a_few_documents(spark, tables):
    pages = spark.createDataFrame([("a", 1, ECHO), ("b", 1, "x"), ("c", 1, None), ("d", 1, "# NOTE\nThere is some pain in the left leg.\nNo fever was seen by the nurse who came today.\nsleeps well")], PAGES)
    got = {r.doc_id: r for r in job.full_reports(pages, tables).collect()}
    assert set(got) == {"a", "d"}  # the others fail the quality gate
    a = got["a"]
    assert (a.report_type, a.status) == ("echocardiography", "CONFIDENT") and a.limitations == []
    found = {f.original_text: f for f in a.key_findings}
    assert found["Mild MR"].concept == "Mitral Regurgitation" and found["Mild MR"].explanation == "Mitral Regurgitation is reported (Mild). Blood flows back."
    assert found["No clot"].assertion == "ABSENT" and found["LA is normal"].assertion == "NORMAL" and found["Mitral valve with MR"].concept == "Mitral Regurgitation"
    assert "mitral valve" in [x.lower() for x in found["Mitral valve with MR"].related_anatomy]
    by = {m.concept: m for m in a.measurements_of_interest}
    assert set(by) == {"EF", "Temperature"}  # the registration number is no measurement
    assert (by["EF"].low, by["EF"].high, by["EF"].converted_value, by["EF"].range_source, by["EF"].significance) == (55.0, 70.0, 60.0, "reported", "WITHIN_REPORTED_RANGE")
    t = by["Temperature"]
    assert (t.low, t.high, round(t.converted_value, 6), t.range_source, t.significance, t.unit) == (36.0, 37.5, 40.0, "loinc_standard", "OUTSIDE_REPORTED_RANGE", "[degF]")
    assert got["d"].status == "UNKNOWN" and got["d"].report_type == "unknown" and got["d"].limitations == ["report type is unknown"] and len(got["d"].key_findings) == 1


def test_an_empty_table(spark, tables):
    assert job.full_reports(spark.createDataFrame([], PAGES), tables).collect() == []


def deepest(df):
    """The most exchanges on a way of rows from a stored table to the result; what is broadcast is another way."""
    worst, way = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        m = re.match(r"^([\s:+-]*)(?:\* ?\(\d+\) |\*\(\d+\) )?(\w+)", line)
        if not m:
            continue
        depth = len(m[1])
        way = [w for w in way if w[0] < depth]
        way.append((depth, m[2]))
        if "BroadcastExchange" not in [w[1] for w in way]:
            worst = max(worst, [w[1] for w in way].count("Exchange"))
    return worst


def test_exchanges_of_the_fact_path(spark, tables):
    pages = kept(spark.createDataFrame([("a", 1, ECHO)], PAGES), "pages")
    with job.plain_unions(spark):
        sections, rows = job.parsed(pages)
        kinds = kept(job.classified(pages, sections, rows, tables), "classified")
        concepts = job.facts_of(sections, rows, kinds, tables)
    stored = kept(concepts, "concepts")
    facts = job.reported(sections, kinds, stored, replace(tables, context=None))
    assert deepest(concepts) <= 4 and deepest(facts) <= 4
    # names of context groups are matched once for all documents, which is a way of its own
    for df in (concepts, job.reported(sections, kinds, stored, tables)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan


def test_the_session_stays_as_it_was(spark):
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    with job.plain_unions(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name, None) == before


def test_own_standards_need_no_join(spark):
    rows = spark.createDataFrame([("a", 1, "T", "100", 100.0, "[degF]", None, "PRESENT", 36.0, 37.5, "Cel")], "doc_id string, concept_no int, concept string, value_raw string, value_num double, unit string, reference_range string, assertion string, std_low double, std_high double, std_unit string")
    out = ranges.significance(rows.withColumn("modifiers", F.create_map().cast("map<string,string>")), conversions=dims.unit_conversions(spark), whole=True).first()
    assert round(out.converted_value, 3) == 37.778 and out.comparison == "ABOVE_REPORTED_REFERENCE_RANGE" and out.range_source == "loinc_standard"
