"""Intake of the whole job: manifests, restarts and states."""

from __future__ import annotations

import pytest

from medtab import schemas
from medtab.streaming import intake
from tests.test_job import ECHO, tables  # noqa: F401  a fixture

UNKNOWN = "# NOTE\nThere is some pain in the left leg.\nNo fever was seen by the nurse who came today.\nsleeps well"


def pages(spark, *rows):
    return spark.createDataFrame([(d, 1, t, fmt, "primary", ok, 0, []) for d, t, fmt, ok in rows], schemas.PAGES)


def test_a_batch_stopped_between_two_tables_counts_once(spark, tables, tmp_path):  # noqa: F811
    land, out, checkpoint = (str(tmp_path / n) for n in ("land", "out", "checkpoint"))
    pages(spark, ("a", ECHO, "markdown", True), ("b", UNKNOWN, "markdown", True), ("c", "x", "markdown", True), ("d", ECHO, "binary", True), ("e", None, "plain", False)).coalesce(1).write.parquet(land)
    stop = [True]

    def write(df, path):
        if "reports" in path and stop[0]:
            stop[0] = False
            raise RuntimeError("stopped")
        df.write.mode("overwrite").parquet(path)

    with pytest.raises(Exception, match="stopped"):
        intake.run_reports(spark, land, out, checkpoint, tables, write)
    assert {r.doc_id: r.status for r in intake.states(spark, out).collect()} == dict.fromkeys("abcde", "processing")
    assert intake.published(spark, out, "concepts", "doc_id string").collect() == []  # written, but not manifested
    intake.run_reports(spark, land, out, checkpoint, tables, write)
    got = {r.doc_id: (r.status, r.error) for r in intake.states(spark, out).collect()}
    assert got == {"a": ("done", None), "b": ("failed", "report type unknown"), "c": ("failed", "quality check failed"), "d": ("failed", "unsupported format"), "e": ("failed", "extraction failed")}
    reports = intake.published(spark, out, "reports", "doc_id string")
    assert [(r.doc_id, r.report_type) for r in reports.collect()] == [("a", "echocardiography")]
    n = intake.published(spark, out, "concepts", "doc_id string").count()
    intake.run_reports(spark, land, out, checkpoint, tables)  # nothing new
    assert intake.published(spark, out, "concepts", "doc_id string").count() == n and reports.count() == 1
    assert intake.latest(reports).count() == 1


def test_an_empty_landing_folder(spark, tables, tmp_path):  # noqa: F811
    land = tmp_path / "land"
    land.mkdir()
    intake.run_reports(spark, str(land), str(tmp_path / "out"), str(tmp_path / "c1"), tables)
    assert intake.states(spark, str(tmp_path / "out")).collect() == [] and intake.published(spark, str(tmp_path / "out"), "reports", "doc_id string").collect() == []
    intake.run_intake(spark, str(land), str(tmp_path / "status"), str(tmp_path / "c2"))
    assert intake.latest_status(spark, str(tmp_path / "status")).collect() == []


def test_terminology_of_several_files(spark, tmp_path):
    from medtab.sources.pages import read_terminology

    (tmp_path / "a.txt").write_text("head | x\n\n\nENTRIES\nHR | heart rate\nAB|one OR two|ambiguous\n")
    (tmp_path / "b.txt").write_text("entries\nMR/MRI | mitral regurgitation | cardiology\n")
    (tmp_path / "c.txt").write_text("no such line\nXX | yy\n")
    got = {(r.surface_form, r.candidate, r.domain, r.line_no, r.ambiguous) for r in read_terminology(spark, str(tmp_path)).collect()}
    assert got == {("HR", "Heart Rate", "general", 4, False), ("AB", "One", "ambiguous", 5, True), ("AB", "Two", "ambiguous", 5, True), ("MR", "Mitral Regurgitation", "cardiology", 1, False), ("MRI", "Mitral Regurgitation", "cardiology", 1, False)}
