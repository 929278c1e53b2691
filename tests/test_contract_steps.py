"""How the steps that the contract queries share are planned."""

import pytest

from forgeline.operators import contracts
from forgeline.plans import file_queries
from forgeline.plans import queries as q


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_judged_once(spark, sf):
    dirty = q._dirty(spark, sf)
    once = plan(contracts.with_violations(dirty, "production", q.AS_OF)).count("RLIKE")
    assert 0 < once
    assert plan(contracts.violations(dirty, "production", ["rid", "content"], q.AS_OF)).count("RLIKE") <= once
    assert plan(contracts.passed(dirty, "production", q.AS_OF)).count("RLIKE") <= once


def test_dirty_rows_are_found_once(spark, sf):
    assert not {"Join", "Aggregate"} & set(plan(q._dirty(spark, sf)).split())


def test_etl_input_is_not_one_task(spark, sf, monkeypatch):
    dealt = []
    real = file_queries._raw_csv
    monkeypatch.setattr(file_queries, "_raw_csv", lambda df, *a: dealt.append(plan(df)) or real(df, *a))
    file_queries._etl_run(spark, sf)
    assert dealt and "Repartition 1," not in dealt[0]


def test_content_is_not_written(spark, sf):
    folder = file_queries._by_machine(spark, sf, "test")
    assert "content" not in spark.read.option("header", True).csv(folder).columns


def test_quarantine_reruns_writes_its_rows_as_parquet(spark, sf, monkeypatch):
    from forgeline.plans import queries
    from forgeline.sources import scratch

    monkeypatch.setattr(scratch, "cut", None)
    assert {r.run_id for r in queries.QUERIES["quarantine_reruns"](spark, sf).collect()} == {"run-1", "run-2"}


def test_only_violations_are_dealt(spark, sf, monkeypatch):
    from forgeline.sources import scratch

    monkeypatch.setattr(scratch, "written", None)
    steps = plan(q._violations(spark, sf))
    assert steps.count("RepartitionByExpression") == 1
    assert steps.index("RepartitionByExpression") < steps.index("isnotnull(v#")


def test_violations_of_rows_with_one_content(spark, monkeypatch):
    from forgeline.sources import views

    row = {c: "1" for c in q._DIRTY} | {"rid": 7, "Date": "2024-01-01", "Line": None, "Target_Qty": "-5"}
    rows = [row, row, row | {"Line": "~"}, row | {"rid": 8, "Line": "L", "Target_Qty": "5"}]
    raw = spark.createDataFrame(rows, "rid bigint, " + ", ".join(f"{c} string" for c in q._DIRTY))
    monkeypatch.setattr(views, "raw_production", lambda s, d: raw)
    found = q.QUERIES["contract_violations"](spark, "").collect()
    assert sorted((r.rid, r.field, r.value, r.rule) for r in found if r.value) == [(7, "Target_Qty", "-5", "range")] * 2
    assert [(r.rid, r.field, r.rule) for r in found if not r.value] == [(7, "Line", "not_blank")]
    assert len({r.content for r in found}) == 1


@pytest.mark.parametrize("name", ["quarantine_rows", "quarantine_summary", "run_quarantine_counts"])
def test_quarantine_is_dealt_once(spark, sf, monkeypatch, name):
    from forgeline.sources import scratch

    monkeypatch.setattr(scratch, "written", None)
    steps = q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Exchange hashpartitioning(rid") == 1


@pytest.mark.parametrize("name", ["quality_gate", "quality_decision"])
def test_checks_write_no_rows(spark, sf, monkeypatch, name):
    from forgeline.sources import scratch

    known = q.QUERIES[name](spark, sf).collect()
    monkeypatch.setattr(scratch, "written", None)
    assert q.QUERIES[name](spark, sf).collect() == known
    once = plan(contracts.with_violations(q._once(spark, sf), "production", q.AS_OF)).count("RLIKE")
    assert plan(q._checks(spark, sf)).count("RLIKE") <= once
