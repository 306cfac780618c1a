"""Every registered query runs at the smallest scale; plans hold no cartesian product and no row-at-a-time Python."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from medtab.plans import intake as _intake  # noqa: F401  registers further queries
from medtab.plans import more as _more  # noqa: F401  registers further queries
from medtab.plans import queries as core

SF = "/root/testdata/sf0.001"


def rows(df):
    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        return "None" if v is None or v != v else (round(float(v), 6) if isinstance(v, float) else str(v))

    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "documents", "events", "nation", "region", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = core.QUERIES[name](spark, SF).toPandas(), con.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(got[cols].astype(object)) == rows(want[cols].astype(object))


@pytest.mark.parametrize("name", ["range_alerts", "class_scores", "findings_dedup", "final_report_counts", "terms_exact"])
def test_plans(spark, name):
    plan = core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["doc_id", "alert_level", "n", "above"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(core.QUERIES) >= 30


def test_sides_are_measured(spark, monkeypatch):
    from medtab.operators import ranges, sides

    rows = spark.createDataFrame([("MM ", 1), ("x", 2), (None, 3)], "unit string, n int")
    aliases = spark.createDataFrame([("mm", "mm"), ("millimetre", "mm")], "alias string, canonical string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, ranges.canonical_units(rows, aliases).collect()), key=str)
    assert "broadcast" in plan(ranges.canonical_units(rows, aliases)) and want == [("MM ", 1, "mm"), ("x", 2, "x"), (None, 3, None)]
    monkeypatch.setattr(sides, "SMALL_BYTES", 10)
    assert "broadcast" not in plan(ranges.canonical_units(rows, aliases)) and sorted(map(tuple, ranges.canonical_units(rows, aliases).collect()), key=str) == want
    assert "broadcast" in plan(rows.join(sides.small(aliases.where("alias = 'zz'")), rows["unit"] == aliases["alias"]))


def test_final_reports_judge_concepts_where_they_stand(spark):
    plan = core.QUERIES["final_report_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of documents with their facts; concepts don't meet themselves again
