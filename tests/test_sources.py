"""Broken input, the store of documents, terms asked once, lines by their first word, definitions of any size."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from medtab import schemas
from medtab.operators import layout, report
from medtab.sources import checked, pages, store
from medtab.streaming import intake


def failed(failures):
    return sorted((r.file.rsplit("/", 1)[-1], r.reason, r.record) for r in failures.collect())


def test_json_pages_with_broken_records(spark, tmp_path):
    good = {"doc_id": "a", "page": 0, "text": "x", "other": 1}
    (tmp_path / "a.json").write_text("\n".join([json.dumps(good), '{"doc_id": "b", "page": ', '{"doc_id": "c", "page": "two"}', '{"page": 1, "text": "y"}', '{"doc_id": "", "page": 1}']))
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c 1.json").write_text("\n \n")
    got, failures = pages.checked_pages(spark, str(tmp_path), "json")
    assert [(r.doc_id, r.page, r.text) for r in got.collect()] == [("a", 1, "x")] and got.columns == [f.split()[0] for f in schemas.PAGES.split(", ")]
    want = [("a.json", "a needed field is missing", None)] * 2 + [("a.json", "a value of another type", '{"doc_id": "c", "page": "two"}'), ("a.json", "broken JSON", '{"doc_id": "b", "page": ')]
    rows = failed(failures)
    assert {(f, why) for f, why, _ in rows} == {(f, why) for f, why, _ in want} | {("b.json", "empty file"), (rows[-1][0], "no record")} and len(rows) == 6
    as_quality = {r.doc_id: (r.status, r.warnings) for r in pages.failure_rows(got, failures).collect()}
    assert as_quality["a.json"] == ("FAILED", ["a needed field is missing", "a value of another type", "broken JSON"]) and len(as_quality) == 3


def test_parquet_pages_with_broken_files(spark, tmp_path):
    one = lambda name, df: df.coalesce(1).write.parquet(str(tmp_path / name))
    rows = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit(1).alias("page_number"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    one("good", rows)
    one("typed", rows.withColumn("page_number", F.lit("one")))
    one("lost", rows.limit(3).withColumn("doc_id", F.lit(None).cast("string")))
    land = tmp_path / "land"
    land.mkdir()
    data = {n: next((tmp_path / n).glob("part*.parquet")).read_bytes() for n in ("good", "typed", "lost")}
    for n, b in data.items():
        (land / f"{n}.parquet").write_bytes(b)
    (land / "cut.parquet").write_bytes(data["good"][: len(data["good"]) // 2])
    (land / "other.parquet").write_bytes(b"these are not rows")
    (land / "empty.parquet").write_bytes(b"")
    got, failures = pages.checked_pages(spark, str(land))
    assert got.count() == 2000 and got.where("page = 1 and fmt = 'markdown'").count() == 2000
    why = "unreadable, without rows, or with columns of another type"
    assert [(f, r) for f, r, _ in failed(failures)] == [("cut.parquet", why), ("empty.parquet", "empty file")] + [("lost.parquet", "a needed field is missing")] * 3 + [("other.parquet", why), ("typed.parquet", why)]


def test_text_and_reports_with_broken_files(spark, tmp_path):
    text, reports, bundles = (tmp_path / n for n in ("text", "reports", "bundles"))
    for d in (text, reports, bundles):
        d.mkdir()
        (d / "empty.json").write_text("")
    (text / "a.txt").write_text("x y")
    (text / "b.txt").write_bytes(b"\xff\xfe\x00binary")
    got, failures = pages.checked_pages(spark, str(text), "text")
    assert [(r.doc_id, r.text, r.fmt) for r in got.collect()] == [("a", "x y", "plain")] and [(f, r) for f, r, _ in failed(failures)] == [("b.txt", "not text"), ("empty.json", "empty file")]
    (reports / "a.json").write_text(json.dumps({"document": {"file_name": "a"}, "sections": [{"title": "T", "page": 1, "text": "x"}]}))
    (reports / "b.json").write_text('{"document": {"file_name": "b"}, "sections": [')
    (reports / "c.json").write_text('{"document": {"file_name": "c", "page_count": "many"}}')
    (reports / "d.json").write_text('{"something": 1}')
    got = pages.read_reports(spark, str(reports))
    assert [r.doc_id for r in got["documents"].collect()] == ["a"] and [r.text for r in got["sections"].collect()] == ["x"]
    assert [(f, r) for f, r, _ in failed(got["failures"])] == [("b.json", "broken JSON"), ("c.json", "a value of another type"), ("d.json", "a needed field is missing"), ("empty.json", "empty file")]
    (bundles / "a.json").write_text(json.dumps({"entry": [{"resource": {"code": {"coding": [{"code": "1"}]}, "qualifiedInterval": [{"range": {"low": {"value": 1.0, "unit": "g"}}}]}}]}))
    (bundles / "b.json").write_text("[1, 2")
    got, failures = pages.checked_ranges(spark, str(bundles))
    assert [(r.code, r.low) for r in got.collect()] == [("1", 1.0)] and [(f, r) for f, r, _ in failed(failures)] == [("b.json", "broken JSON"), ("empty.json", "empty file")]


def test_store_replaces_documents_of_a_run(spark, tmp_path):
    kind = spark.createDataFrame([], "doc_id string, n int").schema
    open_ = lambda name: store.open_table(spark, name, str(tmp_path / name), kind, parts=4, buckets=3)
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    read = lambda name: sorted(((r.doc_id, r.n) for r in spark.table(name).collect()), key=str)
    open_("st_a"), open_("st_b")
    first = [(f"d{i}", k) for i in range(12) for k in range(2)] + [(None, 5)]
    store.put(spark, "st_a", rows(*first))
    assert read("st_a") == sorted(first, key=str)
    store.put(spark, "st_a", rows(("d1", 7), (None, 6)).withColumn("further", F.lit(1)), rows(("d2", 0)))
    want = sorted([x for x in first if x[0] not in ("d1", "d2", None)] + [("d1", 7), (None, 6)], key=str)
    assert read("st_a") == want
    # a run that fails halfway leaves what was there
    broken = rows(("d3", 1), ("d4", 2)).withColumn("n", F.when(F.col("doc_id") == "d4", F.raise_error(F.lit("stopped"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="stopped"):
        store.put(spark, "st_a", broken)
    assert read("st_a") == want
    spark.sql("DROP TABLE st_a")  # only its declaration: the folder is not the catalog's
    assert sorted(((r.doc_id, r.n) for r in open_("st_a").collect()), key=str) == want
    store.put(spark, "st_a", rows(), spark.table("st_a").select("doc_id"))  # no document has rows any more
    assert read("st_a") == []
    store.put(spark, "st_a", rows(*first))
    store.put(spark, "st_b", rows(("d1", 1), ("d5", 2)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = spark.table("st_a").join(spark.table("st_b").withColumnRenamed("n", "m"), "doc_id")
        assert both.count() == 4 and "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE st_a"), spark.sql("DROP TABLE st_b")


def test_terms_are_asked_once(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    asked, stop = [], [True]

    def look_up(keys):
        asked.extend(r.key for r in keys.collect())
        if stop[0]:
            stop[0] = False
            raise RuntimeError("stopped")
        return keys.where("key <> 'zz'").select("key", F.upper("key").alias("definition"), F.lit("x").alias("category")).unionByName(keys.where("key = 'hr'").select("key", F.lit("~").alias("definition"), F.lit("y").alias("category")))

    def arrive(*terms):
        spark.createDataFrame([(t,) for t in terms], "term string").coalesce(1).write.mode("append").parquet(land)

    run = lambda checkpoint="c1": intake.ask_once(spark, land, out, str(tmp_path / checkpoint), look_up, [spark.createDataFrame([(" Old",)], "key string")], files_per_batch=1)
    arrive("HR", " hr ", "old", "zz", None, " ")
    with pytest.raises(Exception, match="stopped"):
        run()
    assert sorted(asked) == ["hr", "zz"]
    asked.clear()
    arrive("hr", "mr")
    arrive("Hr", "MR", "ef")
    run()
    assert sorted(asked) == ["ef", "hr", "mr", "zz"]
    want = {"hr": "HR", "zz": report.NO_RESULT, "mr": "MR", "ef": "EF"}
    assert {r.key: r.definition for r in intake.definitions(spark, out).collect()} == want and intake.definitions(spark, out).count() == 4
    run()  # nothing new
    arrive("zz", "ef", "ab")
    run("c2")  # the state is lost: every file comes again, the definitions are left
    assert sorted(asked) == ["ab", "ef", "hr", "mr", "zz"]
    assert {r.key for r in report.layered([intake.definitions(spark, out)]).collect()} == {"hr", "mr", "ef", "ab"}


def test_lines_equal_a_plain_loop(spark):
    rng = random.Random(3)
    words = [("d", p, i, float(rng.randrange(60) * 10), None if rng.random() < 0.03 else rng.randrange(60) / 2 + i * 0.4, 5.0, rng.choice(["a", "bc", "d e", " ", "f"])) for p in (1, 2, 3) for i in range(80)]
    df = spark.createDataFrame([(d, p, i, x, y, x + w, None if y is None else y + 8, t) for d, p, i, x, y, w, t in words], schemas.WORDS)
    want = {}
    for page in (1, 2, 3):
        lines = []
        for _, p, i, x, y, w, t in words:
            if p == page and t.strip():
                centre = 1e300 if y is None else y + 4
                line = next((ln for ln in lines if abs(ln[0] - centre) <= layout.LINE_GAP), None)
                if line is None:
                    lines.append(line := (centre, []))
                line[1].append((x, i, x + w, t.strip()))
        for k, (_, ws) in enumerate(sorted(lines, key=lambda ln: ln[0])):
            text, last = "", None
            for x, _, end, t in sorted(ws):
                text += t if last is None else (" | " if x - last > layout.COLUMN_GAP else " ") + t
                last = end
            want[page, k + 1] = text
    assert {(r.page, r.line_no): r.line for r in layout.rebuild_lines(df).collect()} == want
    assert layout.rebuild_lines(df.limit(0)).count() == 0


def test_definitions_of_any_size(spark, monkeypatch):
    concepts = spark.createDataFrame([("d", 1, "Clot", "x"), ("d", 2, "none", "EF!"), ("e", 3, "both", "clot"), ("e", 4, None, None), ("e", 4, None, None), ("f", 5, "Clot", "x"), ("f", 6, "", "ef")], "doc_id string, concept_no int, concept string, original_text string")
    defs = spark.createDataFrame([("clot", "A lump."), ("ef", "Share."), ("both", "Two."), ("gone", None), ("Clot ", "B lump.")], "key string, definition string")
    got = sorted(map(str, report.defined(concepts, defs).select("concept_no", "definition").collect()))
    monkeypatch.setattr(report, "is_small", lambda side: False)
    assert sorted(map(str, report.defined(concepts, defs).select("concept_no", "definition").collect())) == got and sum("lump" in g for g in got) == 2
    monkeypatch.undo()
    big = spark.range(10_000_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("definition"))
    plan = report.defined(concepts, big)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Range (0, 10000000") == 1 and "rightHint" not in plan.optimizedPlan().toString()
