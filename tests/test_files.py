"""Row places, broken lines, reruns, nested masking, evidence and the gate's errors."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from forgeline.functions import masking
from forgeline.operators import gate, gold, report
from forgeline.sources import files

PHONE = "0912345678"


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few hundred bytes, so that each has many."""
    names = {"spark.sql.files.maxPartitionBytes": "500b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_row_places_over_many_blocks(spark, tmp_path, small_blocks):
    r = random.Random(1)
    for name, n in (("a.csv", 700), ("b.csv", 1), ("c.csv", 0), ("d.csv", 333)):
        write_lines(tmp_path / name, ["﻿k, v" if name == "a.csv" else "k,v", *[f"{name}-{i},{'x' * r.randrange(30)}" for i in range(n)]])
    rows = files.read_numbered(spark, str(tmp_path))
    assert rows.columns == ["k", "v", "_corrupt", "file", "row_index"] or rows.columns[:2] == ["file", "k"]
    got = {(r.k, r.row_index) for r in rows.collect()}
    assert got == {(f"{name}-{i}", i) for name, n in (("a.csv", 700), ("b.csv", 1), ("d.csv", 333)) for i in range(n)}
    assert spark.read.option("header", True).csv(str(tmp_path)).rdd.getNumPartitions() > 10


def test_every_line_is_kept_or_quarantined(spark, tmp_path):
    cells = [f"{i},b{i},c" if i % 7 else (f"{i},b" if i % 2 else f"{i},b,c,d") for i in range(500)]
    write_lines(tmp_path / "x.csv", ["a,b,c", *cells])
    rows = files.read_numbered(spark, str(tmp_path / "x.csv"))
    bad = files.malformed(rows).collect()
    assert files.whole(rows).count() + len(bad) == 500 and {r.row_index for r in bad} == set(range(0, 500, 7))
    assert {r.value for r in bad} == {cells[i] for i in range(0, 500, 7)} and {r.rule for r in bad} == {"malformed_row"}


def test_cells_of_several_lines(spark, tmp_path):
    write_lines(tmp_path / "m.csv", ["a,b", '1,"two', 'lines"', "3,4", "5"])
    rows = files.read_numbered(spark, str(tmp_path / "m.csv"), multi_line=True)
    assert [(r.a, r.b, r.row_index) for r in files.whole(rows).orderBy("row_index").collect()] == [("1", "two\nlines", 0), ("3", "4", 1)]
    assert [(r.value.strip(), r.row_index) for r in files.malformed(rows).collect()] == [("5", 2)]


def test_json_lines_are_kept_or_reported(spark, tmp_path):
    lines = ['{"id":"1","n":3}', "broken", '{"id":"2","n":"three"}', '{"id":"3"}', '[{"id":"4"}', '{"id":"5","n":5,"more":[1]}']
    write_lines(tmp_path / "log.jsonl", lines)
    good, bad = files.scan_json_lines(spark, str(tmp_path / "log.jsonl"), "id string, n int")
    assert sorted((r.id, r.n) for r in good.fillna(-1).collect()) == [("1", 3), ("3", -1), ("5", 5)]
    assert {r.line for r in bad.collect()} == {lines[1], lines[2], lines[4]} and bad.first().file.endswith("log.jsonl")


def test_a_rerun_replaces_its_own_quarantine_only(spark, tmp_path):
    rows = spark.createDataFrame([("f", "r1", "d")], "field string, run_id string, dataset string")
    for run, what in (("r1", rows), ("r2", rows), ("r1", rows), ("r2", rows.filter("false"))):
        files.write_quarantine(what, f"{tmp_path}/q", run, "d")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/q").collect()] == [("f", "r1", "d")]


def test_two_runs_of_the_etl_leave_equal_tables(spark, tmp_path):
    header = "Date,Line,Shift,Product,Machine_ID,Worker_ID,Target_Qty,Actual_Qty,Good_Qty,Reject_Qty,Cycle_Time_sec"
    good = "2024-01-01,L1,Morning,A,M-01,W1,100,90,80,10,30.5"
    write_lines(tmp_path / "production.csv", [header, good, good.replace("L1", " "), "2024-01-01,L1"])
    tables = []
    for _ in range(2):
        done = files.run_etl(spark, f"{tmp_path}/production.csv", f"{tmp_path}/out", "r1", "2026-01-01")["production"]
        tables.append((done.collect(), sorted((r.row_index, r.rule) for r in spark.read.parquet(f"{tmp_path}/out/quarantine").collect())))
    assert tables[0] == tables[1] and len(tables[0][0]) == 1 and tables[0][1] == [(1, "not_blank"), (2, "malformed_row")]


def test_masking_of_nested_bodies(spark):
    body = {
        "messages": [{"role": "user", "content": f"a {PHONE}"}, {"role": "user", "content": [{"type": "text", "text": PHONE}, {"type": "image"}, "odd", {"text": 7}]}, {"content": None}, "odd", {"content": 912345678}],
        "input": ["x", f"{PHONE} {PHONE}", 5],
    }
    rows = [(1, json.dumps(body)), (2, json.dumps({"input": f"y {PHONE}", "messages": "no list"})), (3, "no json"), (4, "[1]"), (5, None), (6, '"text"')]
    got = {(r.k, r.path): (r.text, r.redactions) for r in masking.masked_bodies(spark.createDataFrame(rows, "k int, body string"), "body", ["k"]).collect()}
    t = masking.TOKEN
    assert got == {(1, "messages[0].content"): (f"a {t}", 1), (1, "messages[1].content[0].text"): (t, 1), (1, "input[0]"): ("x", 0), (1, "input[1]"): (f"{t} {t}", 2), (2, "input"): (f"y {t}", 1)}


def test_the_gate_stays_shut_when_it_fails(spark):
    bad = spark.range(1).select(F.raise_error(F.lit("no storage")).alias("Date"))
    row = gate.judged(spark, lambda: gate.evaluate(spark, dict.fromkeys(gate.REQUIRED_DATASETS, spark.range(3)), {"oee": bad.select(F.col("Date").cast("double").alias("x")), "daily_production": spark.range(1)})).first()
    assert row.status == "UNKNOWN" and row.reason.startswith("quality evaluation error") and len(row.reason) <= 500
    row = gate.judged(spark, lambda: gate.evaluate(spark, {"production": spark.range(0)}, {})).first()
    assert row.status == "BAD" and row.reason == "empty validated dataset(s): production; missing required dataset(s): inventory, machine, quality, workers"
    row = gate.judged(spark, lambda: gate.evaluate(spark, dict.fromkeys(gate.REQUIRED_DATASETS, spark.range(3)), {})).first()
    assert (row.status, row.reason, row.failed) == ("GOOD", "all checks passed", "")


def test_no_dated_row_is_an_error(spark):
    rows = spark.createDataFrame([("never", "L", "M", 1, 1, 1, 0, 1.0)], "Date string, Line string, Machine_ID string, Target_Qty int, Actual_Qty int, Good_Qty int, Reject_Qty int, Cycle_Time_sec double")
    with pytest.raises(ValueError, match="Date parses"):
        gold.oee_daily(rows)


def test_one_snapshot_over_all_evidence(spark):
    def made(value, sets=("b", "a")):
        rows = spark.createDataFrame([("d1", value), ("d0", 9.0)], "Date string, x double")
        return {r.source_id: r for r in report.evidence({"k": rows, "none": rows.filter("false")}, {"k": ["Date"], "none": ["Date"]}, list(sets)).collect()}

    one = made(1.5)
    assert sorted(one) == ["dataset:a", "dataset:b", "kpi:k"] and one["kpi:k"].row == '{"Date":"d1","x":"1.5000"}'
    assert len({r.snapshot_id for r in one.values()}) == 1 and made(1.5)["kpi:k"] == one["kpi:k"]
    assert len({one["kpi:k"].snapshot_id, made(2.5)["kpi:k"].snapshot_id, made(1.5, ("a",))["kpi:k"].snapshot_id}) == 3
