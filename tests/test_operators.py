"""Operators on small tables: rules, edge cases and invariants."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from forgeline.functions import columns, masking
from forgeline.operators import clean, contracts, dashboard, gate, gold, kpi, ledger, lineage, ml, reqlog
from forgeline.plans import queries, spec
from forgeline.sources import files, views
from forgeline.streaming import telemetry

GOOD = ("2024-01-01", "L1", "Morning", "A", "M-01", "W1", "100", "90", "80", "10", "30.5")
FIELDS = list(contracts.CONTRACTS["production"])


def production(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["id int", *[f"{c} string" for c in FIELDS]]))


def changed(**values):
    return tuple(values.get(c, v) for c, v in zip(FIELDS, GOOD, strict=True))


@pytest.mark.parametrize(
    ("row", "field", "rule"),
    [
        (changed(Line="  "), "Line", "not_blank"),
        (changed(Worker_ID=None), "Worker_ID", "not_blank"),
        (changed(Actual_Qty="4.5"), "Actual_Qty", "type_int"),
        (changed(Actual_Qty="abc"), "Actual_Qty", "type_int"),
        (changed(Target_Qty="-1"), "Target_Qty", "range"),
        (changed(Cycle_Time_sec="NaN"), "Cycle_Time_sec", "finite"),
        (changed(Cycle_Time_sec="Infinity"), "Cycle_Time_sec", "finite"),
        (changed(Date="nonsense"), "Date", "type_date"),
        (changed(Date="2999-01-01"), "Date", "not_in_future"),
        (changed(Reject_Qty="91"), "__model__", "Reject_Qty_le_Actual_Qty"),
    ],
)
def test_contract_rules(spark, row, field, rule):
    found = contracts.violations(production(spark, GOOD, row), "production", ["id"], "2026-01-01").collect()
    assert [(r.id, r.field, r.rule) for r in found] == [(1, field, rule)]


def test_cross_rule_waits_for_good_fields(spark):
    found = contracts.violations(production(spark, changed(Reject_Qty="91", Line="")), "production", ["id"], "2026-01-01").collect()
    assert [r.rule for r in found] == ["not_blank"]


def test_missing_column_and_unknown_dataset(spark):
    found = contracts.violations(production(spark, GOOD).drop("Shift"), "production", ["id"], "2026-01-01").collect()
    assert [(r.field, r.rule) for r in found] == [("Shift", "missing")]
    with pytest.raises(ValueError, match="unknown data set"):
        contracts.with_violations(production(spark, GOOD), "nothing")


def test_gate_conserves_rows(spark):
    df = production(spark, GOOD, changed(Line=None, Actual_Qty="x"), GOOD)
    kept, rejected = contracts.gate(df, "production", ["id"], "/a/production.csv", "r1", "2026-01-01", "2026-01-01 00:00:00")
    assert kept.count() + rejected.select("id").distinct().count() == df.count()
    assert {r.source_file for r in rejected.collect()} == {"production.csv"}
    assert dict(kept.dtypes)["Actual_Qty"] == "bigint"


@pytest.mark.parametrize("cell", ["=1+1", "+x", "-2", "@a", " \t=b"])
def test_safe_cells(spark, cell):
    assert spark.createDataFrame([(cell,)], "c string").select(columns.safe_cell(F.col("c"))).first()[0] == "'" + cell


def test_clean_order_and_idempotence(spark):
    df = spark.createDataFrame([("a ", "-5"), ("a ", "-5"), ("a", "-5"), (None, "x"), ("b", "10"), ("c", None)], "Line string, Actual_Qty string")
    out = clean.clean(df)
    rows = sorted((r.Line, r.Actual_Qty) for r in out.collect())
    # rows that only trimming makes equal stay, and the median of -5, -5, 10 fills
    assert rows == [("Unknown_Line", 0.0), ("a", 0.0), ("a", 0.0), ("b", 10.0), ("c", 0.0)]
    assert sorted(clean.clean(df.unionAll(df)).collect()) == sorted(out.collect())
    assert clean.clean(df.filter("false")).count() == 0


def test_median_of_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert max(r.x for r in clean.fill_median(df).filter("x not in (1, 2, 3, 10)").collect()) == 2.5


def test_ratios_with_zero_denominator(spark):
    row = spark.createDataFrame([(5, 0)], "a int, b int").select(columns.ratio_or_num(F.col("a"), F.col("b")), columns.ratio_or_null(F.col("a"), F.col("b")), columns.ratio_from_one(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (5.0, None, 5.0)


def test_oee_keeps_unmatched_days(spark):
    production = spark.createDataFrame([("2024-01-01", 100, 90, 81)], "Date string, Target_Qty int, Actual_Qty int, Good_Qty int")
    machine = spark.createDataFrame([("2024-01-02", 5)], "Date string, Downtime_min int")
    out = {r.Date: r for r in kpi.oee(production, machine).collect()}
    assert out["2024-01-01"].OEE_pct is None and out["2024-01-01"].Performance_pct == 90.0
    assert out["2024-01-02"].Availability_pct == 50.0


def test_gold_conserves_sums_and_requires_columns(spark, sf):
    raw = views.production(spark, sf)
    totals = gold.oee_daily(raw).agg(F.sum("Total_Actual"), F.sum("Total_Reject")).first()
    assert tuple(totals) == tuple(raw.agg(F.sum("Actual_Qty"), F.sum("Reject_Qty")).first())
    with pytest.raises(ValueError, match="Cycle_Time_sec"):
        gold.oee_daily(raw.drop("Cycle_Time_sec"))
    with pytest.raises(ValueError, match="no rows"):
        gold.checked(raw.filter("false"), "production")


def test_unlisted_severity_goes_to_other(spark):
    df = spark.createDataFrame([("2024-01-01", "p", "l", "t", 3, 10, "Odd"), ("2024-01-01", "p", "l", "t", 4, 10, None)], "Date string, Product string, Line string, Defect_Type string, Defect_Count int, Inspected_Qty int, Severity string")
    assert gold.quality_daily(df).first().Defects_Other == 7


def test_grain_violations_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert sorted(r.v for r in gold.grain_violations(df, ["k"]).collect()) == [1, 2]


def test_rule_states(spark):
    rows = [("a", True, True, "NONE"), ("b", False, True, "CRITICAL"), ("c", True, False, "WARNING"), ("d", None, True, "NONE"), ("e", True, True, "CRITICAL")]
    out = {r.run_id: r for r in gate.state_and_severity(spark.createDataFrame(rows, "run_id string, passed boolean, blocking boolean, severity string")).collect()}
    assert [(out[k].state, out[k].severity, out[k].eligible) for k in "abcd"] == [("GOOD", "NONE", True), ("BAD", "CRITICAL", False), ("GOOD", "WARNING", True), ("UNKNOWN", None, False)]
    assert not out["e"].valid and not out["e"].eligible


def test_gate_finds_what_is_missing(spark, sf):
    checks = gate.evaluate(spark, {"production": views.production(spark, sf).filter("false")}, {}, spark.sql("SELECT 10L AS passed, 90L AS rejected"), "current_run")
    assert {r.name for r in checks.filter("NOT ok").collect()} == {"datasets_present", "datasets_non_empty", "quarantine_rate"}
    assert gate.decision(checks).first().status == "BAD"


@pytest.mark.parametrize(
    "bad",
    [
        {"frame": "drop table x", "metric": "v"},
        {"frame": "t", "metric": "nope"},
        {"frame": "t", "metric": "k"},
        {"frame": "t", "metric": "v", "agg": "median"},
        {"frame": "t", "metric": "v", "group_by": ["z"]},
        {"frame": "t", "metric": "v", "top_n": "x"},
        {"frame": "t", "metric": "v", "filters": [{"column": "k", "op": "like", "value": "a"}]},
        {"frame": "t", "metric": "v", "filters": [{"column": "k", "op": "in", "value": "a"}]},
        "select 1",
    ],
)
def test_spec_rejects(spark, bad):
    with pytest.raises(ValueError):
        spec.execute(bad, {"t": spark.createDataFrame([("a", 1)], "k string, v int")})


def test_spec_groups_and_totals(spark):
    t = {"t": spark.createDataFrame([("a", 1), ("a", 2), (None, 5), ("b", None)], "k string, v int")}
    rows = spec.execute({"frame": "t", "metric": "v", "group_by": ["k"], "top_n": 50}, t).collect()
    assert [tuple(r) for r in rows] == [(None, 5), ("a", 3), ("b", None)]
    assert spec.execute({"frame": "t", "metric": "v", "agg": "count"}, t).first().v == 4
    assert spec.execute({"frame": "t", "metric": "v", "filters": [{"column": "v", "op": ">", "value": 9}]}, t).count() == 0


def test_positional_quantiles(spark):
    df = spark.createDataFrame([("p", float(x)) for x in range(1, 21)], "k string, v double")
    assert tuple(reqlog.positional(df, ["k"], "v", {"a": 0.5, "b": 0.95}).first()) == ("p", 11.0, 20.0)


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "source_dataset string, target_dataset string")
    assert lineage.closure(edges).filter("ancestor = 'a'").count() == 3
    assert {r.dataset for r in lineage.cycles(edges).collect()} == {"x", "y"}
    assert lineage.closure(edges.filter("false")).count() == 0


def test_default_catalog_is_sound(spark):
    assert lineage.catalog_problems(lineage.default_catalog(spark)).count() == 0


def test_canonical_attempts(spark):
    rows = [("r", "s", 1, "FAILED"), ("r", "s", 2, "SUCCEEDED"), ("r", "s", 3, "SUCCEEDED"), ("q", "s", 1, "FAILED"), ("q", "s", 2, "RETRYABLE")]
    out = {r.run_id: (r.attempt, r.attempt_count) for r in ledger.canonical_attempts(spark.createDataFrame(rows, "run_id string, stage string, attempt int, status string")).collect()}
    assert out == {"r": (2, 3), "q": (2, 2)}


def test_masking(spark):
    text = "gọi +84 912 345 678 hoặc 0912345678, số 123456789012 và 123456789,987654321"
    row = spark.createDataFrame([(text,)], "t string").select(masking.masked(F.col("t")), masking.redactions(F.col("t"))).first()
    assert row[1] == 5 and row[0].count(masking.TOKEN) == 5 and "123456789" not in row[0]


def test_modal_status_tie(spark):
    df = spark.createDataFrame([("2024-01-01", "m", "Running"), ("2024-01-01", "m", "Idle")], "Date string, Machine_ID string, Status string")
    assert dashboard.modal_status(df).first().Status == "Idle"


def test_split_is_stable(spark, sf):
    df = ml.downtime_features(views.machine(spark, sf))
    train, test = ml.split(df, ["Reading"])
    assert train.count() + test.count() == df.count() and train.join(test, "Reading").count() == 0


def test_models_learn(spark, sf):
    row = queries.QUERIES["rf_metrics"](spark, sf).first()
    assert 0.5 < row.accuracy <= 1


# --- files ------------------------------------------------------------------------------------------
def test_etl_from_files(spark, sf, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    header = ",".join([*FIELDS, "Created_At"])
    lines = [",".join([*GOOD, "x"]), ",".join([*changed(Line=" "), "x"]), ",".join([*changed(Product="=cmd"), "x"])]
    (raw / "2024_production.csv").write_text("﻿" + header + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    (raw / "notes.txt").write_text("nothing")
    found = {r.dataset: r.path for r in files.discover_files(spark, str(raw)).collect()}
    assert list(found) == ["production"] and found["production"].endswith("2024_production.csv")
    done = files.run_etl(spark, str(raw), f"{tmp_path}/out", "r1", "2026-01-01")
    assert done["production"].count() == 2
    quarantined = spark.read.parquet(f"{tmp_path}/out/quarantine")
    assert [(r.field, r.rule, r.dataset) for r in quarantined.collect()] == [("Line", "not_blank", "production")]
    assert files.validate_csv(spark, str(raw / "2024_production.csv"), as_of="2026-01-01").count() == 1
    with pytest.raises(ValueError):
        files.infer_dataset("notes.txt")


def test_exports_and_marts(spark, sf, tmp_path):
    df = gold.oee_daily(views.production(spark, sf))
    assert files.export_silver(df, f"{tmp_path}/a", "parquet") == df.count() == files.export_silver(df, f"{tmp_path}/b", "csv")
    manifest = files.export_gold(spark, {"gold_oee_daily": df}, f"{tmp_path}/gold").first()
    assert (manifest.rows, manifest.columns) == (df.count(), len(df.columns))
    files.write_marts({"mart_oee_test": gold.mart(df, "mart_oee")})
    files.write_marts({"mart_oee_test": gold.mart(df, "mart_oee")})
    counts = {r.mart: r.rows for r in files.mart_row_counts(spark, ["mart_oee_test", "mart_nowhere"]).collect()}
    assert counts == {"mart_oee_test": df.count(), "mart_nowhere": -1}
    assert files.query(spark, "SELECT count(*) FROM mart_oee_test").first()[0] == df.count()
    files.export_report({"oee": df}, f"{tmp_path}/report")
    assert files.read_csv(spark, f"{tmp_path}/report/oee").count() == df.count()
    assert files.preview(df, 5).count() == 5
    spark.sql("DROP TABLE mart_oee_test")


def test_request_log_skips_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id":"1","latency_ms":3}\nbroken\n{"id":"2","latency_ms":4}\n')
    assert files.read_request_log(spark, f"{tmp_path}/log.jsonl", "id string, latency_ms double").filter("id IS NOT NULL").count() == 2


def test_fingerprint_ignores_order(spark, sf):
    df = views.machine(spark, sf)
    a, b = files.fingerprint({"m": df}), files.fingerprint({"m": df.repartition(3).orderBy(F.desc("Reading"))})
    assert [r.result for r in files.verify(a, b).collect()] == ["ok"]


# --- streaming --------------------------------------------------------------------------------------
BODIES = [
    '{"id":"a","Machine_ID":"m","Date":"d","Line":"l","Speed_RPM":5}',
    '{"id":"a","Machine_ID":"m","Date":"d","Line":"l"}',
    '{"message_id":"b","Date":"d","Line":"l"}',
    '{"Machine_ID":"m","Date":"d","Line":"l","Speed_RPM":-1}',
    '{"Line":"l","Machine_ID":"m","Speed_RPM":-1,"Date":"d"}',
    "not json",
]


def test_telemetry_batch(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "n int, body string")
    out = telemetry.with_duplicates(telemetry.checked(telemetry.parsed(df)), ["n"]).orderBy("n").collect()
    assert [r.status for r in out] == ["accepted", "duplicate_skipped", "quarantined", "quarantined", "duplicate_skipped", "quarantined"]
    assert out[2].reason == "missing Machine_ID" and len(out[3].message_id) == 16


def test_telemetry_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", b) for i, b in enumerate(BODIES[:4])]
    spark.createDataFrame(rows, "at string, body string").selectExpr("CAST(at AS TIMESTAMP) AS at", "body").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, body string").parquet(f"{tmp_path}/in")
    once = telemetry.distinct_stream(telemetry.checked(telemetry.parsed(stream)), "at", "1 hour")
    for _ in range(2):  # started again, it finds nothing new
        telemetry.start_ingest(once, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "r").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/accepted").count() == 1
    assert spark.read.parquet(f"{tmp_path}/out/quarantined").count() == 2
    total = spark.read.parquet(f"{tmp_path}/out/manifest").agg(F.sum("accepted"), F.sum("quarantined")).first()
    assert tuple(total) == (1, 2)


def test_stream_reports_duplicates(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", b) for i, b in enumerate(BODIES)]
    for part in (rows[:3], rows[3:], rows[:2]):
        spark.createDataFrame(part, "at string, body string").selectExpr("CAST(at AS TIMESTAMP) AS at", "body").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("at timestamp, body string").parquet(f"{tmp_path}/in")
        telemetry.start_ingest(telemetry.checked(telemetry.parsed(stream)), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "r", ["at"]).awaitTermination()
    counts = [tuple(r)[1:4] for r in spark.read.parquet(f"{tmp_path}/out/manifest").orderBy("batch").drop("checksum").collect()]
    assert counts == [(1, 1, 1), (0, 2, 1), (0, 0, 2)]
    assert spark.read.parquet(f"{tmp_path}/out/duplicate_skipped").count() == 4


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, "at string, body string").selectExpr("CAST(at AS TIMESTAMP) AS at", "body").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("at timestamp, body string").parquet(f"{folder}/in")
    return telemetry.checked(telemetry.parsed(stream))


def _body(name):
    return '{"id":"%s","Machine_ID":"m","Date":"d","Line":"l"}' % name


def test_repeats_are_kept_and_their_state_goes(spark, tmp_path):
    """Late messages are kept as they come; ids that don't come again leave the state, and count as new after that."""
    early, late = "2024-01-01 00:00:00", "2020-01-01 00:00:00"
    state = []
    for rows, wait in (([(early, _body(f"i{k}")) for k in range(30)] + [(early, _body("i1"))], 4), ([(late, _body("i2")), (late, _body("new"))], 0), ([(early, _body("i2"))], 0)):
        query = telemetry.start_ingest(_arrive(spark, tmp_path, rows), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "r", ["at"], retention_s=1.0 if wait else 2000.0, at="at")
        query.awaitTermination()
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]][-1])
        time.sleep(wait)
    assert state == [30, 2, 2]
    manifests = spark.read.parquet(f"{tmp_path}/out/manifest").orderBy("batch").collect()
    assert [(m.accepted, m.duplicate_skipped) for m in manifests][0] == (30, 1)
    assert sum(m.accepted for m in manifests) == 32 and sum(m.duplicate_skipped for m in manifests) == 2 and not (tmp_path / "out/ids").exists()
    kept = spark.read.parquet(f"{tmp_path}/out/accepted").unionByName(spark.read.parquet(f"{tmp_path}/out/duplicate_skipped"))
    assert kept.count() == 34 and kept.filter("year(at) = 2020").count() == 2


def test_a_run_in_another_runs_folder_is_reported(spark, tmp_path):
    telemetry.start_ingest(_arrive(spark, tmp_path / "a", [("2024-01-01 00:00:00", _body("a"))]), f"{tmp_path}/out", f"{tmp_path}/c1", "r").awaitTermination()
    before = spark.read.parquet(f"{tmp_path}/out/accepted").collect()
    telemetry.start_ingest(_arrive(spark, tmp_path / "a", []), f"{tmp_path}/out", f"{tmp_path}/c3", "r").awaitTermination()  # the same messages again: a retry
    with pytest.raises(Exception, match="another run"):
        telemetry.start_ingest(_arrive(spark, tmp_path / "b", [("2024-01-01 00:00:00", _body("b"))]), f"{tmp_path}/out", f"{tmp_path}/c2", "r").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/accepted").collect() == before
    conflict = spark.read.parquet(f"{tmp_path}/out/manifest_conflicts").collect()
    assert [(c.run_id, c.met_run_id) for c in conflict] == [("r-0", "r-0")] and conflict[0].checksum != conflict[0].met_checksum


def test_checksums_count_repeats(spark):
    def checksum(*ids):
        return telemetry.manifest(spark.createDataFrame([(i, "accepted") for i in ids], "message_id string, status string"), "r").first().checksum

    assert len({checksum("a", "b"), checksum("a", "b", "b"), checksum("a", "a", "b"), checksum("a", "b", "c", "c")}) == 4 and checksum("a", "b") == checksum("b", "a")


def test_sketched_percentiles_stay_near_the_exact_rank(spark):
    log = spark.range(60_000).selectExpr("timestamp_seconds(1704067200 + id % 600) AS ts", "concat('p', id % 2) AS project", "500 AS status", "CAST(pmod(xxhash64(id), 100000) AS DOUBLE) AS latency_ms")
    exact = log.groupBy(F.window("ts", "5 minutes", "15 seconds"), "project").agg(F.array_sort(F.collect_list("latency_ms")).alias("all")).select(F.col("window.start").alias("start"), "project", "all")
    both = telemetry.slow_windows(log, k=200).join(exact, ["start", "project"]).collect()
    assert len(both) == 2 * 59
    assert all(abs(sum(v <= r.p95_ms for v in r["all"]) / len(r["all"]) - 0.95) < 0.025 for r in both)
    plan = telemetry.slow_windows(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # panes are spread over windows, not rows


def test_window_alerts_on_a_stream(spark, sf, tmp_path):
    log = views.request_log(spark, sf).select("ts", "project", "status", "latency_ms")
    log.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    telemetry.error_ratio(stream, delay="1 minute").writeStream.format("memory").queryName("ratios").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    closed = spark.table("ratios")
    batch = telemetry.error_ratio(log)
    assert closed.count() > 0 and closed.exceptAll(batch).count() == 0
