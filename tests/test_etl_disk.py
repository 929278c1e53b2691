"""What the file run leaves on disk and shuffles: no row before its duplicates are looked for, and only those that may have one there."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from forgeline.operators import clean, contracts
from forgeline.plans import queries as q
from forgeline.sources import files, scratch, views

HEADER = "Date,Line,Shift,Product,Machine_ID,Worker_ID,Target_Qty,Actual_Qty,Good_Qty,Reject_Qty,Cycle_Time_sec"
GOOD = "2024-01-01,L1,Morning,A,M-01,W1,100,90,80,10,30.5"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcasts(spark):
    """As for tables that are too large to be broadcast by Catalyst's own choice."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbered_rows_are_not_shuffled(spark, tmp_path, no_broadcasts):
    (tmp_path / "production.csv").write_text("\n".join([HEADER, *[GOOD] * 9]) + "\n")
    rows = files.read_numbered(spark, f"{tmp_path}/production.csv")
    assert "SortMergeJoin" not in plan(rows) and sorted(r.row_index for r in rows.collect()) == list(range(9))


def test_a_run_leaves_only_its_tables(spark, tmp_path):
    (tmp_path / "production.csv").write_text("\n".join([HEADER, GOOD, GOOD, GOOD.replace("30.5", "30.50"), GOOD.replace("L1", "L2"), GOOD.replace("90", "-1"), "2024-01-01,L1"]) + "\n")
    home = scratch.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{home}/*-*/*.parquet"))
    done = files.run_etl(spark, f"{tmp_path}/production.csv", f"{tmp_path}/out", "r1", "2026-01-01")["production"]
    assert sorted(r.Line for r in done.collect()) == ["L1", "L2"]
    assert sorted((r.row_index, r.rule) for r in spark.read.parquet(f"{tmp_path}/out/quarantine").collect()) == [(4, "range"), (5, "malformed_row")]
    assert not set(glob.glob(f"{home}/*-*/*.parquet")) - before


def test_what_a_block_releases(spark):
    home = scratch.shared_folder(spark).removeprefix("file:")
    outer = scratch.written(spark.range(3), "outer")
    with pytest.raises(ValueError), scratch.released(spark):
        scratch.written(spark.range(3), "first")
        with scratch.released(spark):
            scratch.written(spark.range(3), "second")
        assert glob.glob(f"{home}/first-*") and not glob.glob(f"{home}/second-*")
        raise ValueError
    assert outer.count() == 3 and not glob.glob(f"{home}/first-*")


@pytest.mark.parametrize("most", [0, 2, 1000])
def test_few_copies_are_found_by_hash(spark, most):
    odd = [0.0, -0.0, float("nan"), None, float("inf"), 1.5, 1.5]
    rows = [(k % 3, x, None if k % 2 else "t", [k % 2]) for k in range(12) for x in odd] + [(k, float(k), "once", None) for k in range(100, 300)]
    df = spark.createDataFrame(rows, "k int, x double, t string, l array<int>")
    seen = lambda d: sorted((r.k, repr(r.x + 0.0) if r.x is not None else "", r.t or "", str(r.l)) for r in d.collect())
    got = clean.dedup_few(df, most)
    assert seen(got) == seen(clean.dedup_exact(df)) and got.columns == df.columns and got.count() == 12 // 2 * 5 + 200
    assert ("left_anti" in got._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftanti", "left_anti")) == (most >= 1000)
    assert clean.dedup_few(df.filter("false"), most).count() == 0


def test_columns_without_a_plain_hash(spark):
    df = spark.sql("SELECT * FROM VALUES (array(1), 'a' COLLATE UTF8_LCASE), (array(1), 'A' COLLATE UTF8_LCASE), (array(2), 'b' COLLATE UTF8_LCASE) AS x(l, t)")
    assert clean.dedup_few(df).count() == clean.dedup_exact(df).count() == 2


def test_both_ways_of_cleaning_agree(spark, sf):
    raw = views.raw_production(spark, sf)
    some, all_rows = clean.clean(raw, few_copies=True), clean.clean(raw)
    assert some.schema == all_rows.schema and some.exceptAll(all_rows).isEmpty() and all_rows.exceptAll(some).isEmpty()


def test_rows_are_dealt_before_they_are_texts(spark, sf):
    once = q._once(spark, sf)
    tree = plan(once)
    assert tree.count("Exchange hashpartitioning") == 1 and tree.index("explode(") < tree.index("Exchange hashpartitioning")
    want = views.raw_production(spark, sf).distinct()
    assert once.exceptAll(want).isEmpty() and want.exceptAll(once).isEmpty()


def test_rows_judged_once_pass_the_same_gate(spark, sf):
    rows = views.raw_production(spark, sf).distinct().withColumn("content", q._content())
    judged = scratch.written(contracts.with_violations(rows, "production", q.AS_OF), "judged")
    at = ("production", ["rid", "content"], "/raw/production.csv", "run-1")
    for mine, theirs in zip(contracts.gate_judged(judged, *at, at="2026-01-01 00:00:00"), contracts.gate(rows, *at, q.AS_OF, "2026-01-01 00:00:00")):
        assert mine.columns == theirs.columns and mine.count() > 0
        mine, theirs = (x.select(*[F.col(c) for c in sorted(x.columns)]) for x in (mine, theirs))
        assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
