"""One query for each operator over the given tables, and its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions import masking
from forgeline.functions.columns import finite, safe_cell
from forgeline.operators import alerts, clean, contracts, dashboard, gate, gold, kpi, ledger, lineage, ml, report, reqlog
from forgeline.plans import inputs, spec
from forgeline.sources import files, scratch, views
from forgeline.streaming import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2026-01-01"
QUOTA = 20_000
NOW = "2024-01-20 00:00:00"
#: A time by which many leases, but not all, have expired.
LATER = "2024-01-30 12:00:00"
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
DATASETS = {"production": views.production, "quality": views.quality, "inventory": views.inventory, "machine": views.machine, "workers": views.workers}
_VIEW_OF = {"production": "v_production", "quality": "v_quality", "inventory": "v_inventory", "machine": "v_machine", "workers": "v_workers"}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = _with_views(sql)


def _with_views(sql: str) -> str:
    """The SQL with the views that it names, and those that these name, before it."""
    known = views.VIEWS_SQL | inputs.SQL | STEPS
    needed: list[str] = []
    begun: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in known and name not in begun:
                begun.add(name)
                visit(known[name])
                needed.append(name)

    visit(sql)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({known[n]})" for n in needed) + " " + sql if needed else sql


def _pct(num: str, den: str, digits: int = 2) -> str:
    return f"round(({num}) * 100e0 / CASE WHEN ({den}) = 0 THEN 1 ELSE ({den}) END, {digits})"


def _null_pct(num: str, den: str) -> str:
    return f"round(({num}) * 100e0 / nullif({den}, 0), 2)"


def _sum(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


_PROD_SUMS = f"{_sum('Target_Qty')} AS Total_Target, {_sum('Actual_Qty')} AS Total_Actual, {_sum('Good_Qty')} AS Total_Good, {_sum('Reject_Qty')} AS Total_Reject"
_PROD_RATES = f"{_pct('sum(Actual_Qty)', 'sum(Target_Qty)')} AS Achievement_Rate_pct, {_pct('sum(Reject_Qty)', 'sum(Actual_Qty)')} AS Reject_Rate_pct"

#: Intermediate tables of the oracles.
STEPS = {
    "k_daily": f"SELECT Date, {_PROD_SUMS}, avg(Cycle_Time_sec) AS Avg_Cycle_Time, count(*) AS Records, {_PROD_RATES}, {_pct('sum(Good_Qty)', 'sum(Actual_Qty)')} AS Yield_Rate_pct FROM v_production GROUP BY Date",
    "k_up": f"SELECT Date, count(Downtime_min) AS Total_Time, {_sum('Downtime_min')} AS Downtime_Total, {_pct('count(Downtime_min) * 10 - sum(Downtime_min)', 'count(Downtime_min) * 10')} AS Availability_pct FROM v_machine GROUP BY Date",
    "k_made": f"SELECT OEE_Date AS Date, {_pct('sum(Actual_Qty)', 'sum(Target_Qty)')} AS Performance_pct, {_pct('sum(Good_Qty)', 'sum(Actual_Qty)')} AS Quality_pct FROM v_production GROUP BY OEE_Date",
    "k_oee": "SELECT coalesce(u.Date, m.Date) AS Date, Total_Time, Downtime_Total, Availability_pct, Performance_pct, Quality_pct, round(Availability_pct / 100 * (Performance_pct / 100) * (Quality_pct / 100) * 100, 2) AS OEE_pct FROM k_up u FULL OUTER JOIN k_made m ON u.Date = m.Date",
    "k_util": "SELECT Date, Machine_ID, count(*) FILTER (Status = 'Running') AS Running_Count, count(*) FILTER (Status = 'Idle') AS Idle_Count, count(*) FILTER (Status = 'Maintenance') AS Maintenance_Count, count(*) FILTER (Status = 'Failure') AS Failure_Count, "
    f"{_sum('Downtime_min')} AS Total_Downtime, avg(Temperature_C) AS Avg_Temperature, avg(Vibration_mm) AS Avg_Vibration, avg(Power_Usage_pct) AS Avg_Power, count(*) AS Total_Readings, {_pct('count(*) FILTER (Status = ' + chr(39) + 'Running' + chr(39) + ')', 'count(*)')} AS Utilization_pct FROM v_machine GROUP BY Date, Machine_ID",
    "k_inv": f"SELECT Date, {_sum('Stock_Qty')} AS Total_Stock, {_sum('Incoming_Qty')} AS Total_Incoming, {_sum('Outgoing_Qty')} AS Total_Outgoing, avg(Stock_Qty) AS Avg_Stock, min(Stock_Qty) AS Min_Stock, count(*) FILTER (Stock_Qty <= Reorder_Point) AS Products_Below_Reorder, round(sum(Stock_Qty * Unit_Price), 2) AS Stock_Value FROM v_inventory GROUP BY Date",
    "k_type": f"SELECT Defect_Type, {_sum('Defect_Count')} AS Total_Defects, {_sum('Inspected_Qty')} AS Total_Inspected, count(*) AS Occurrences, {_pct('sum(Defect_Count)', 'sum(Inspected_Qty)')} AS Defect_Rate_pct FROM v_quality GROUP BY Defect_Type",
    "k_def": f"SELECT Date, {_sum('Defect_Count')} AS Total_Defects, {_sum('Inspected_Qty')} AS Total_Inspected, {_pct('sum(Defect_Count)', 'sum(Inspected_Qty)')} AS Defect_Rate_pct FROM v_quality GROUP BY Date",
    "g_oee": f"SELECT Date, {_PROD_SUMS}, avg(Cycle_Time_sec) AS Avg_Cycle_Time, count(DISTINCT Machine_ID) AS Machines, count(DISTINCT Shift) AS Shifts, 100e0 AS Availability_pct, {_null_pct('sum(Actual_Qty)', 'sum(Target_Qty)')} AS Performance_pct, {_null_pct('sum(Good_Qty)', 'sum(Actual_Qty)')} AS Quality_pct, round({_null_pct('sum(Actual_Qty)', 'sum(Target_Qty)')} * {_null_pct('sum(Good_Qty)', 'sum(Actual_Qty)')} / 100, 2) AS OEE_pct FROM v_production GROUP BY Date",
    "g_qual": "SELECT Date, " + f"{_sum('Defect_Count')} AS Total_Defects, {_sum('Inspected_Qty')} AS Total_Inspected, count(DISTINCT Defect_Type) AS Defect_Types, count(DISTINCT Product) AS Products, count(DISTINCT Line) AS Lines, " + ", ".join(f"CAST(coalesce(sum(Defect_Count) FILTER (Severity = '{s}'), 0) AS BIGINT) AS Defects_{s}" for s in gold.SEVERITIES) + f", CAST(0 AS BIGINT) AS Defects_Other, {_null_pct('sum(Defect_Count)', 'sum(Inspected_Qty)')} AS Defect_Rate_pct, round(100e0 - sum(Defect_Count) * 100e0 / nullif(sum(Inspected_Qty), 0), 2) AS Pass_Rate_pct FROM v_quality GROUP BY Date",
    "g_snap": f"SELECT *, round(Stock_Qty * Unit_Price, 2) AS Stock_Value, Stock_Qty < Reorder_Point AS Below_Reorder, {_null_pct('Stock_Qty', 'Max_Capacity')} AS Capacity_pct, CASE WHEN Stock_Qty <= 0 THEN 'OUT_OF_STOCK' WHEN Stock_Qty < Reorder_Point THEN 'REORDER' WHEN {_null_pct('Stock_Qty', 'Max_Capacity')} > 90 THEN 'OVER_CAPACITY' ELSE 'OK' END AS Stock_Status, Date AS Snapshot_Date FROM v_inventory WHERE Date = (SELECT max(Date) FROM v_inventory)",
    "d_day": "SELECT * FROM k_daily ORDER BY Date DESC LIMIT 1",
    "d_oee": "SELECT * FROM k_oee ORDER BY Date DESC NULLS LAST LIMIT 1",
    "d_mach": "SELECT * FROM v_machine WHERE Date = (SELECT max(Date) FROM v_machine)",
    "d_inv": "SELECT * FROM v_inventory WHERE Date = (SELECT max(Date) FROM v_inventory)",
    "a_all": f"SELECT *, TIMESTAMP '{NOW}' AS \"timestamp\" FROM a_rules",
    "a_rules": """
SELECT CASE WHEN Reject_Rate_pct < 7.5 THEN 'WARNING' ELSE 'CRITICAL' END AS level, 'Quality' AS category, 'Reject rate ' || CAST(CAST(round(Reject_Rate_pct, 1) AS DECIMAL(18,1)) AS VARCHAR) || '% exceeds 5.0%' AS message, Reject_Rate_pct AS value, 5e0 AS threshold, 'Production' AS source FROM d_day WHERE Reject_Rate_pct > 5
UNION ALL SELECT 'WARNING', 'Production', 'Achievement only ' || CAST(CAST(round(Achievement_Rate_pct, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%', Achievement_Rate_pct, 80e0, 'Production' FROM d_day WHERE Achievement_Rate_pct < 80
UNION ALL SELECT CASE WHEN Stock_Qty < 100 THEN 'CRITICAL' ELSE 'WARNING' END, 'Inventory', 'Low stock of ' || Product || ': ' || CAST(Stock_Qty AS VARCHAR) || ' left', Stock_Qty, 200e0, 'Inventory' FROM d_inv WHERE Stock_Qty <= 200
UNION ALL SELECT 'WARNING', 'Inventory', 'Reorder ' || Product || ': ' || CAST(Stock_Qty AS VARCHAR) || ' of ' || CAST(Reorder_Point AS VARCHAR), Stock_Qty, Reorder_Point, 'Inventory' FROM d_inv WHERE Stock_Qty <= Reorder_Point
UNION ALL SELECT CASE WHEN Downtime_min > 60 THEN 'CRITICAL' ELSE 'WARNING' END, 'Machine', 'Machine ' || Machine_ID || ': ' || CAST(Downtime_min AS VARCHAR) || ' min down (' || Status || ')', Downtime_min, 30e0, 'Machine_' || Machine_ID FROM d_mach WHERE Downtime_min > 30
UNION ALL SELECT 'CRITICAL', 'Machine', 'Machine ' || Machine_ID || ': failure', NULL, NULL, 'Machine_' || Machine_ID FROM d_mach WHERE Status = 'Failure'
UNION ALL SELECT 'WARNING', 'Machine', 'Machine ' || Machine_ID || ': temperature ' || CAST(CAST(round(Temperature_C, 1) AS DECIMAL(18,1)) AS VARCHAR), Temperature_C, 85e0, 'Machine_' || Machine_ID FROM d_mach WHERE Temperature_C > 85 AND Status = 'Running'
UNION ALL SELECT 'WARNING', 'Machine', 'Machine ' || Machine_ID || ': vibration ' || CAST(CAST(round(Vibration_mm, 1) AS DECIMAL(18,1)) AS VARCHAR), Vibration_mm, 8e0, 'Machine_' || Machine_ID FROM d_mach WHERE Vibration_mm > 8 AND Status = 'Running'
UNION ALL SELECT 'WARNING', 'OEE', 'OEE at ' || CAST(CAST(round(OEE_pct, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%', OEE_pct, 85e0, 'OEE' FROM d_oee WHERE OEE_pct < 85""",
    "a_first": "SELECT * FROM a_all ORDER BY CASE level WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END, \"timestamp\", category, source, message LIMIT 5",
    "w_abc": "SELECT Product, round(Stock_Qty * Unit_Price, 2) AS Stock_Value, round(sum(round(Stock_Qty * Unit_Price, 2)) OVER (ORDER BY round(Stock_Qty * Unit_Price, 2) DESC, Product ROWS UNBOUNDED PRECEDING) * 100e0 / sum(round(Stock_Qty * Unit_Price, 2)) OVER (), 2) AS Cumulative_pct FROM d_inv",
    "w_abc2": "SELECT *, CASE WHEN Cumulative_pct <= 70 THEN 'A' WHEN Cumulative_pct <= 90 THEN 'B' ELSE 'C' END AS Class FROM w_abc",
    "l_tok": "SELECT event_id, project, CAST(ts AS DATE) AS day, CAST(greatest(1, floor(prompt_chars / 4)) + greatest(0, floor(completion_chars / 4)) AS BIGINT) AS tokens, ts FROM v_log",
    # the dirty table's violations, one row each, every rule written out
    "c_dirty": "SELECT DISTINCT *, " + " || '|' || ".join(f"coalesce({c}, '~')" for c in ["Date", "Line", "Shift", "Product", "Machine_ID", "Worker_ID", "Target_Qty", "Actual_Qty", "Good_Qty", "Reject_Qty", "Cycle_Time_sec"]) + " AS content FROM v_raw",
    "c_viol": " UNION ALL ".join(
        [f"SELECT rid, content, '{c}' AS field, {c} AS value, CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'not_blank' END AS rule FROM c_dirty" for c in ("Line", "Shift", "Product", "Machine_ID", "Worker_ID")]
        + [f"SELECT rid, content, '{c}', {c}, CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'not_blank' WHEN NOT regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN 'type_int' WHEN try_cast(trim({c}) AS BIGINT) < 0 THEN 'range' END FROM c_dirty" for c in ("Target_Qty", "Actual_Qty", "Good_Qty", "Reject_Qty")]
        + [f"SELECT rid, content, 'Date', Date, CASE WHEN Date IS NULL OR trim(Date) = '' THEN 'not_blank' WHEN try_cast(trim(Date) AS DATE) IS NULL THEN 'type_date' WHEN try_cast(trim(Date) AS DATE) > DATE '{AS_OF}' THEN 'not_in_future' END FROM c_dirty"]
        + ["SELECT rid, content, 'Cycle_Time_sec', Cycle_Time_sec, CASE WHEN Cycle_Time_sec IS NULL OR trim(Cycle_Time_sec) = '' THEN 'not_blank' WHEN try_cast(trim(Cycle_Time_sec) AS DOUBLE) IS NULL THEN 'type_float' WHEN NOT isfinite(try_cast(trim(Cycle_Time_sec) AS DOUBLE)) THEN 'finite' WHEN try_cast(trim(Cycle_Time_sec) AS DOUBLE) < 0 THEN 'range' END FROM c_dirty"]
    ),
    "c_field": "SELECT * FROM c_viol WHERE rule IS NOT NULL",
    "c_cross": "SELECT rid, content, '__model__' AS field, Reject_Qty AS value, 'Reject_Qty_le_Actual_Qty' AS rule FROM c_dirty d WHERE try_cast(Reject_Qty AS BIGINT) > try_cast(Actual_Qty AS BIGINT) AND NOT EXISTS (SELECT 1 FROM c_field f WHERE f.rid = d.rid AND f.content = d.content)",
    "c_all": "SELECT * FROM c_field UNION ALL SELECT * FROM c_cross",
    "x_num": "SELECT * REPLACE (" + ", ".join(f"CASE WHEN isnan(try_cast({c} AS DOUBLE)) THEN NULL ELSE try_cast({c} AS DOUBLE) END AS {c}" for c in ["Target_Qty", "Actual_Qty", "Good_Qty", "Reject_Qty", "Cycle_Time_sec"]) + ") FROM v_raw",
    "x_once": "SELECT DISTINCT * FROM x_num",
    "m_parsed": "SELECT event_id, body, CASE WHEN event_id % 17 = 0 THEN substr(sha256(body), 1, 16) ELSE CAST(CASE WHEN event_id % 10 = 3 THEN event_id - 1 ELSE event_id END AS VARCHAR) END AS message_id, CASE WHEN event_id % 13 = 0 AND event_id % 19 = 0 THEN 'missing Machine_ID, Line' WHEN event_id % 13 = 0 THEN 'missing Machine_ID' WHEN event_id % 19 = 0 THEN 'missing Line' WHEN event_id % 23 = 0 OR event_id % 29 = 0 THEN 'negative or non-numeric speed' END AS reason FROM v_messages",
    "m_done": "SELECT event_id, message_id, CASE WHEN n > 1 THEN 'duplicate_skipped' WHEN reason IS NULL THEN 'accepted' ELSE 'quarantined' END AS status, CASE WHEN n > 1 THEN 'already processed' ELSE reason END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY event_id) AS n FROM m_parsed)",
    "s_disp": f"SELECT message_id, d.run_id, d.stage, CASE WHEN error_code IS NOT NULL THEN 'DEAD_LETTER' WHEN status = 'SUCCEEDED' THEN 'ACK_DUPLICATE' WHEN status = 'RUNNING' AND lease_until > TIMESTAMP '{NOW}' THEN 'DEFER' WHEN status IN ('FAILED', 'DEAD_LETTERED') THEN 'DEAD_LETTER' ELSE 'PROCESS' END AS disposition FROM v_deliveries d LEFT JOIN v_ledger l ON d.run_id = l.run_id AND d.stage = l.stage",
    "t_clos": "SELECT source_dataset AS ancestor, target_dataset AS descendant FROM v_edges UNION SELECT c.ancestor, e.target_dataset FROM t_clos c JOIN v_edges e ON c.descendant = e.source_dataset",
}


# --- KPIs -------------------------------------------------------------------------------------------
def _oee(s: SparkSession, d: str) -> DataFrame:
    return kpi.oee(views.production(s, d), views.machine(s, d), date_col="OEE_Date")


_add("daily_production", lambda s, d: kpi.daily_production(views.production(s, d)), "SELECT * FROM k_daily")
_add("weekly_production", lambda s, d: kpi.weekly_production(views.production(s, d)), f"SELECT CAST(year(Date) AS INTEGER) AS Year, CAST(weekofyear(Date) AS INTEGER) AS Week, {_PROD_SUMS}, avg(Cycle_Time_sec) AS Avg_Cycle_Time, {_PROD_RATES} FROM v_production GROUP BY ALL")
_add("monthly_production", lambda s, d: kpi.monthly_production(views.production(s, d)), f"SELECT CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month, {_PROD_SUMS}, avg(Cycle_Time_sec) AS Avg_Cycle_Time, {_PROD_RATES} FROM v_production GROUP BY ALL")
_add("oee", lambda s, d: _oee(s, d).orderBy("Date"), "SELECT * FROM k_oee")
_add("machine_utilization", lambda s, d: kpi.machine_utilization(views.machine(s, d)), "SELECT * FROM k_util")
_add("worker_productivity", lambda s, d: kpi.worker_productivity(views.workers(s, d)), f"SELECT Date, Worker_ID, Line, Shift, round(sum(Hours_Worked), 6) AS Total_Hours, {_sum('Units_Produced')} AS Total_Units, {_sum('Defects_Caused')} AS Total_Defects, round(sum(Overtime_hrs), 6) AS Total_Overtime, round(sum(Units_Produced) / CASE WHEN round(sum(Hours_Worked), 6) = 0 THEN 1 ELSE round(sum(Hours_Worked), 6) END, 1) AS Units_Per_Hour, {_pct('sum(Defects_Caused)', 'sum(Units_Produced)')} AS Defect_Rate_pct FROM v_workers GROUP BY ALL")
_add("inventory_kpi", lambda s, d: kpi.inventory_kpi(views.inventory(s, d)), "SELECT * FROM k_inv")
_add("defects_by_type", lambda s, d: kpi.defects_by_type(views.quality(s, d)), "SELECT * FROM k_type")
_add("defects_by_severity", lambda s, d: kpi.defects_by_severity(views.quality(s, d)), f"SELECT Severity, {_sum('Defect_Count')} AS Total_Defects, count(*) AS Occurrences FROM v_quality GROUP BY Severity")
_add("defects_daily", lambda s, d: kpi.defects_daily(views.quality(s, d)), "SELECT * FROM k_def")

# --- gold and marts ---------------------------------------------------------------------------------
_add("gold_oee_daily", lambda s, d: gold.oee_daily(views.production(s, d)), "SELECT * FROM g_oee")
_add("gold_quality_daily", lambda s, d: gold.quality_daily(views.quality(s, d)), "SELECT * FROM g_qual")
_add("gold_inventory_snapshot", lambda s, d: gold.inventory_snapshot(views.inventory(s, d)), "SELECT * FROM g_snap")
_add("gold_machine_health", lambda s, d: gold.machine_health(views.machine(s, d), down_values=("DOWN", "Failure")), f"SELECT Date, count(DISTINCT Machine_ID) AS Machines, round(avg(Temperature_C), 2) AS Avg_Temperature, round(max(Temperature_C), 2) AS Max_Temperature, round(avg(Vibration_mm), 3) AS Avg_Vibration, round(max(Vibration_mm), 3) AS Max_Vibration, CASE WHEN max(Temperature_C) > 75 THEN 1 ELSE 0 END + CASE WHEN max(Vibration_mm) > 4.5 THEN 1 ELSE 0 END AS Warning_Count, {_sum('Downtime_min')} AS Total_Downtime, count(*) FILTER (Status IN ('DOWN', 'Failure')) AS Down_Count, CASE (CASE WHEN max(Temperature_C) > 75 THEN 1 ELSE 0 END + CASE WHEN max(Vibration_mm) > 4.5 THEN 1 ELSE 0 END) WHEN 0 THEN 'HEALTHY' WHEN 1 THEN 'WARN' ELSE 'CRITICAL' END AS Health_Status FROM v_machine GROUP BY Date")
_add("mart_oee", lambda s, d: gold.mart(gold.oee_daily(views.production(s, d)), "mart_oee"), f"SELECT {', '.join(gold.MART_COLUMNS['mart_oee'])} FROM g_oee")
_add("mart_quality", lambda s, d: gold.mart(gold.quality_daily(views.quality(s, d)), "mart_quality"), f"SELECT {', '.join(gold.MART_COLUMNS['mart_quality'])} FROM g_qual")
_add("mart_inventory", lambda s, d: gold.mart(gold.inventory_snapshot(views.inventory(s, d)), "mart_inventory"), f"SELECT {', '.join(gold.MART_COLUMNS['mart_inventory'])} FROM g_snap")
_add("kpi_summary", lambda s, d: gold.kpi_summary(gold.oee_daily(views.production(s, d)), gold.quality_daily(views.quality(s, d)), gold.inventory_snapshot(views.inventory(s, d))), f"SELECT * FROM (SELECT {_sum('Total_Actual')} AS total_actual, {_sum('Total_Reject')} AS total_reject, round(avg(OEE_pct), 2) AS avg_oee, count(*) AS days FROM g_oee), (SELECT {_sum('Total_Defects')} AS total_defects, round(avg(Defect_Rate_pct), 2) AS avg_defect_rate FROM g_qual), (SELECT count(*) FILTER (Stock_Status <> 'OK') AS skus_not_ok, round(sum(Stock_Value), 2) AS total_stock_value FROM g_snap)")
_add("grain_violations", lambda s, d: gold.grain_violations(views.production(s, d).select("Date", "Machine_ID", "Worker_ID", "Actual_Qty"), ["Date", "Machine_ID", "Worker_ID"]), "SELECT Date, Machine_ID, Worker_ID, Actual_Qty, n AS Rows_In_Key FROM (SELECT *, count(*) OVER (PARTITION BY Date, Machine_ID, Worker_ID) AS n FROM v_production) WHERE n > 1")
_add("severity_pivot_join", lambda s, d: _severity_join(s, d), f"SELECT q.Date, {_sum('q.Defect_Count')} AS Total_Defects, " + ", ".join(f"CAST(coalesce(sum(Defect_Count) FILTER (Severity = '{x}'), 0) AS BIGINT) AS {x}" for x in gold.SEVERITIES) + " FROM v_quality q GROUP BY q.Date")


def _severity_join(s: SparkSession, d: str) -> DataFrame:
    q = views.quality(s, d)
    pivot = q.groupBy("Date").pivot("Severity", list(gold.SEVERITIES)).agg(F.sum("Defect_Count"))
    return q.groupBy("Date").agg(F.sum("Defect_Count").alias("Total_Defects")).join(pivot, "Date", "left").na.fill(0)


# --- cleaning ---------------------------------------------------------------------------------------
_NUM = ["Target_Qty", "Actual_Qty", "Good_Qty", "Reject_Qty", "Cycle_Time_sec"]
_add("coerce_measures", lambda s, d: clean.coerce(views.raw_production(s, d)), "SELECT * FROM x_num")
_add("dedup_exact", lambda s, d: clean.dedup_exact(clean.coerce(views.raw_production(s, d))), "SELECT * FROM x_once")
_add("fill_median", lambda s, d: clean.fill_median(clean.coerce(views.raw_production(s, d)).select("rid", *_NUM), _NUM), "SELECT rid, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM x_num)) AS {c}" for c in _NUM) + " FROM x_num")
_add("fill_unknown", lambda s, d: clean.fill_unknown(views.raw_production(s, d).select("rid", "Worker_ID", "Line")), "SELECT rid, coalesce(Worker_ID, 'Unknown_Worker_ID') AS Worker_ID, coalesce(Line, 'Unknown_Line') AS Line FROM v_raw")
_add("fill_forward", lambda s, d: clean.fill_forward(clean.parse_dates(views.raw_production(s, d).select("Machine_ID", "rid", "Date", F.col("Date").alias("raw")).distinct()), ["Date"], ["rid", "raw"], ["Machine_ID"]), "SELECT Machine_ID, rid, Date AS raw, last_value(try_cast(Date AS DATE) IGNORE NULLS) OVER (PARTITION BY Machine_ID ORDER BY rid, Date ROWS UNBOUNDED PRECEDING) AS Date FROM (SELECT DISTINCT Machine_ID, rid, Date FROM v_raw)")
_add("parse_dates", lambda s, d: clean.parse_dates(views.raw_production(s, d).select("rid", "Date")), "SELECT rid, try_cast(Date AS DATE) AS Date FROM v_raw")
_add("standardize_text", lambda s, d: clean.standardize_text(views.raw_production(s, d).select("rid", "Line")), "SELECT rid, trim(Line) AS Line FROM v_raw")
_add("clip_negative", lambda s, d: clean.clip_negative(clean.coerce(views.raw_production(s, d)).select("rid", "Target_Qty", "Actual_Qty")), "SELECT rid, greatest(Target_Qty, 0) AS Target_Qty, CASE WHEN Actual_Qty < 0 THEN 0 ELSE Actual_Qty END AS Actual_Qty FROM x_num")
_add("clip_negative_counts", lambda s, d: clean.clip_negative(views.quality(s, d).select("Date", "Line", (F.col("Defect_Count") - 5).alias("Defect_Count"), (F.col("Inspected_Qty") - 120).alias("Inspected_Qty"))), "SELECT Date, Line, greatest(Defect_Count - 5, 0) AS Defect_Count, greatest(Inspected_Qty - 120, 0) AS Inspected_Qty FROM v_quality")
_add("clip_negative_units", lambda s, d: clean.clip_negative(views.workers(s, d).select("Date", "Worker_ID", (F.col("Units_Produced") - 150).alias("Units_Produced"), (F.col("Defects_Caused") - 3).alias("Defects_Caused"))), "SELECT Date, Worker_ID, greatest(Units_Produced - 150, 0) AS Units_Produced, Defects_Caused - 3 AS Defects_Caused FROM v_workers")
_CLEAN = "SELECT rid, try_cast(Date AS DATE) AS Date, " + ", ".join(f"trim(coalesce({c}, 'Unknown_{c}')) AS {c}" for c in ["Line", "Shift", "Product", "Machine_ID", "Worker_ID"]) + ", " + ", ".join(f"CASE WHEN coalesce({c}, (SELECT median({c}) FROM x_once)) < 0 THEN 0 ELSE coalesce({c}, (SELECT median({c}) FROM x_once)) END AS {c}" for c in _NUM[:4]) + ", coalesce(Cycle_Time_sec, (SELECT median(Cycle_Time_sec) FROM x_once)) AS Cycle_Time_sec FROM x_once"
_add("clean_production", lambda s, d: clean.clean(views.raw_production(s, d)), _CLEAN)
_add("clean_basic", lambda s, d: clean.clean(clean.coerce(views.production(s, d)).select("Date", "Line", "Target_Qty", "Actual_Qty"), "basic"), "SELECT DISTINCT Date, Line, CAST(Target_Qty AS DOUBLE) AS Target_Qty, CAST(Actual_Qty AS DOUBLE) AS Actual_Qty FROM v_production")
_add("finite_measures", lambda s, d: clean.coerce(views.raw_production(s, d)).select("rid", finite(F.col("Cycle_Time_sec")).alias("Cycle_Time_sec"), finite(F.col("Target_Qty")).alias("Target_Qty")), "SELECT rid, CASE WHEN isfinite(Cycle_Time_sec) THEN Cycle_Time_sec END AS Cycle_Time_sec, Target_Qty FROM x_num")
_add("safe_cells", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", safe_cell(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" ="), "text")).otherwise(F.col("text"))).alias("cell")), "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ''' =' || text WHEN regexp_matches(text, '^[ \\t]*[=+@-]') THEN '''' || text ELSE text END AS cell FROM documents")

def _whole_cell() -> Column:
    return safe_cell(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" ="), "text")).otherwise(F.col("text")))


_add("safe_cells_whole", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", _whole_cell().alias("cell")).select("doc_id", F.sha2("cell", 256).alias("sha256"), F.length("cell").cast("long").alias("n_chars")), "SELECT doc_id, sha256(cell) AS sha256, length(cell) AS n_chars FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ''' =' || text WHEN regexp_matches(text, '^[ \\t]*[=+@-]') THEN '''' || text ELSE text END AS cell FROM documents)")
_add("scaled_copies", lambda s, d: dashboard.shifted_copies(views.production(s, d), 10, 100).groupBy("Date").agg(F.sum("Actual_Qty").alias("Actual")), f"SELECT CAST(Date + CAST(i * 100 AS INTEGER) AS DATE) AS Date, {_sum('Actual_Qty')} AS Actual FROM v_production, range(10) AS r(i) GROUP BY 1")

# --- contracts, quarantine, gate --------------------------------------------------------------------
_DIRTY = ["Date", "Line", "Shift", "Product", "Machine_ID", "Worker_ID", *_NUM]


def _content() -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in _DIRTY])


def _once(s: SparkSession, d: str) -> DataFrame:
    """The raw rows, equal ones once. They are dealt by the row key, so that no task holds more rows than its share."""
    return views.raw_production(s, d, dealt=True).distinct()


def _dirty(s: SparkSession, d: str) -> DataFrame:
    """The raw rows, equal ones once, with `content`, all their texts in one. They are written once, so that no row is shuffled with its content,
    and later steps read them instead of finding them again."""
    return scratch.written(_once(s, d), "dirty").withColumn("content", _content())


def _violations(s: SparkSession, d: str) -> DataFrame:
    """Equal rows break the same rules: every raw row is judged where it is read, only what breaks a rule is dealt by the row key, and repeats go there.
    The whole row goes with its violation, as rows that differ can have one `content`."""
    raw = views.raw_production(s, d)
    found = contracts.violations(raw, "production", raw.columns, AS_OF).repartition("rid").distinct()
    return found.select("rid", _content().alias("content"), "ord", "field", "value", "rule")


def _quarantined(s: SparkSession, d: str) -> DataFrame:
    return contracts.quarantine(_violations(s, d), ["rid", "content"], "production", "/raw/production.csv", "run-1", "2026-01-01 00:00:00")


def _passed(s: SparkSession, d: str) -> DataFrame:
    return contracts.passed(_dirty(s, d), "production", AS_OF)


_GOOD = "SELECT rid, content FROM c_dirty d WHERE NOT EXISTS (SELECT 1 FROM c_all a WHERE a.rid = d.rid AND a.content = d.content)"
_add("contract_violations", lambda s, d: _violations(s, d).drop("ord"), "SELECT rid, content, field, value, rule FROM c_all")
_add("contract_passed", lambda s, d: _passed(s, d).select("rid", "content"), _GOOD)


def _without_rejected(s: SparkSession, d: str) -> DataFrame:
    dirty = _dirty(s, d)
    rejected = contracts.violations(dirty, "production", ["rid", "content"], AS_OF).select("rid", "content").distinct()
    return dirty.select("rid", "content").join(rejected, ["rid", "content"], "left_anti")


_add("rejected_rows_removed", _without_rejected, _GOOD)
_add("quarantine_rows", lambda s, d: _quarantined(s, d).drop("quarantined_at"), "SELECT 'production' AS dataset, 'production.csv' AS source_file, rid, content, field, CASE WHEN regexp_matches(coalesce(value, ''), '^[ \\t]*[=+@-]') THEN '''' || value ELSE coalesce(value, '') END AS value, rule, 'run-1' AS run_id FROM c_all")
_add("quarantine_summary", lambda s, d: contracts.quarantine_summary(_quarantined(s, d)), "SELECT 'production' AS dataset, count(*) AS rows FROM c_all")
_add("run_quarantine_counts", lambda s, d: contracts.run_counts(_quarantined(s, d), "run-1"), "SELECT 'production' AS dataset, count(*) AS rows FROM c_all")


def _context(s: SparkSession, d: str) -> DataFrame:
    dirty = _dirty(s, d)
    found = contracts.violations(dirty, "production", ["rid", "content"], AS_OF)
    # read twice, and few beside the rows that pass
    rows = scratch.cut(contracts.quarantine(found, ["rid", "content"], "production", "/raw/production.csv", "run-1", "2026-01-01 00:00:00").select("dataset", "run_id"))
    passed = contracts.passed(dirty, "production", AS_OF).agg(F.count(F.lit(1)).alias("passed"))
    return contracts.quality_context(passed, contracts.run_counts(rows, "run-1"), contracts.quarantine_summary(rows)).drop("by_dataset")


_add("quality_context", _context, f"SELECT (SELECT count(*) FROM ({_GOOD})) AS passed, count(*) AS rejected, count(*) AS dlq_cumulative_rows, 'current_run' AS scope FROM c_all")


def _checks(s: SparkSession, d: str) -> DataFrame:
    sets = {n: f(s, d) for n, f in DATASETS.items()}
    kpis = {"daily_production": kpi.daily_production(sets["production"]), "oee": _oee(s, d), "inventory_kpi": kpi.inventory_kpi(sets["inventory"])}
    rejected = F.size("violations") > 0
    # read by one aggregate only, so that it needn't be written
    counts = contracts.with_violations(_once(s, d), "production", AS_OF).agg(F.count_if(~rejected).alias("passed"), F.count_if(rejected).alias("rejected"))
    return gate.evaluate(s, sets, kpis, counts, "current_run")


_GATE = "SELECT 'datasets_present' AS name, true AS ok, 'all required present' AS detail, CAST(NULL AS VARCHAR) AS failure UNION ALL SELECT 'datasets_non_empty', true, 'all non-empty', NULL UNION ALL SELECT 'kpi_inputs_present', true, 'required KPIs present', NULL UNION ALL SELECT 'kpi_values_finite', count(*) = 0, CASE WHEN count(*) = 0 THEN 'no NaN/inf' ELSE 'non-finite=oee' END, CASE WHEN count(*) > 0 THEN 'non-finite KPI(s): oee' END FROM k_oee WHERE OEE_pct IS NULL UNION ALL SELECT 'quarantine_rate', r <= 0.5, 'rate=' || format('{:.3f}', r) || ' (max=0.5, scope=current_run)', CASE WHEN r > 0.5 THEN 'quarantine rate ' || format('{:.3f}', r) || ' exceeds 0.5' END FROM (SELECT 1 - (SELECT count(*) FROM (" + _GOOD + ")) / CAST((SELECT count(*) FROM c_dirty) AS DOUBLE) AS r)"
_add("quality_gate", _checks, _GATE)
_add("quality_evidence", lambda s, d: gate.evidence({n: f(s, d) for n, f in DATASETS.items()}), " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS rows, min(Date) AS first_date, max(Date) AS last_date FROM {v}" for n, v in _VIEW_OF.items()))
_add("quality_decision", lambda s, d: gate.judged(s, lambda: _checks(s, d)), f"SELECT CASE WHEN bool_and(ok) THEN 'GOOD' ELSE 'BAD' END AS status, count(*) AS checks, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS failed, coalesce(string_agg(failure, '; ' ORDER BY name) FILTER (NOT ok), 'all checks passed') AS reason FROM ({_GATE})")
_add("rule_severity", lambda s, d: gate.state_and_severity(inputs.view(s, d, "v_rules")), "SELECT run_id, state, severity, blocking_failures, warnings, criticals, NOT (state = 'GOOD' AND criticals > 0) AS valid, state = 'GOOD' AND criticals = 0 AS eligible FROM (SELECT run_id, CASE WHEN u > 0 THEN 'UNKNOWN' WHEN f > 0 THEN 'BAD' ELSE 'GOOD' END AS state, CASE WHEN u > 0 THEN NULL WHEN f > 0 THEN CASE WHEN c > 0 THEN 'CRITICAL' ELSE 'WARNING' END WHEN w > 0 THEN 'WARNING' ELSE 'NONE' END AS severity, f AS blocking_failures, w AS warnings, c AS criticals FROM (SELECT run_id, count(*) FILTER (passed IS NULL) AS u, count(*) FILTER (blocking AND NOT passed) AS f, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'WARNING') AS w FROM v_rules GROUP BY run_id))")


def _ratio(s: SparkSession, d: str) -> DataFrame:
    dirty = _dirty(s, d)
    return gate.quarantine_ratio(dirty.agg(F.count(F.lit(1)).alias("n")), contracts.passed(dirty, "production", AS_OF).agg(F.count(F.lit(1)).alias("n")))


_add("quarantine_ratio", _ratio, f"SELECT r - k AS dropped, k AS kept, round((r - k) / CAST(r AS DOUBLE), 4) AS ratio, round((r - k) / CAST(r AS DOUBLE), 4) <= 0.25 AS ok FROM (SELECT (SELECT count(*) FROM c_dirty) AS r, (SELECT count(*) FROM ({_GOOD})) AS k)")
_add("end_of_run_checks", lambda s, d: gate.end_of_run(gold.oee_daily(views.production(s, d))), "SELECT count(*) AS rows, round(sum(Total_Reject) / CAST(sum(Total_Actual) AS DOUBLE), 4) AS reject_rate, count(*) > 0 AS mart_not_empty, sum(Total_Reject) / CAST(sum(Total_Actual) AS DOUBLE) BETWEEN 0 AND 0.3 AS reject_rate_ok, sum(Total_Good) + sum(Total_Reject) <= sum(Total_Actual) AS balance_ok FROM g_oee")

# --- dashboards -------------------------------------------------------------------------------------
_RANK = f"SELECT Worker_ID, round(sum(Hours_Worked), 6) AS Hours, {_sum('Units_Produced')} AS Units, {_sum('Defects_Caused')} AS Defects, round(sum(Units_Produced) / greatest(round(sum(Hours_Worked), 6), 1), 1) AS Units_Per_Hour, round(sum(Defects_Caused) * 100 / CAST(greatest(sum(Units_Produced), 1) AS DOUBLE), 1) AS Defect_pct FROM v_workers GROUP BY Worker_ID"
_add("worker_ranking", lambda s, d: dashboard.worker_ranking(views.workers(s, d)), _RANK)
_add("worker_top10", lambda s, d: dashboard.top_workers(views.workers(s, d)), f"SELECT * FROM ({_RANK}) ORDER BY Units_Per_Hour DESC, Worker_ID LIMIT 10")
_add("status_share", lambda s, d: dashboard.status_share(views.machine(s, d)), "SELECT Status, count(*) AS Readings, round(count(*) * 100e0 / sum(count(*)) OVER (), 1) AS Share_pct FROM d_mach GROUP BY Status")
_add("production_totals", lambda s, d: dashboard.production_totals(views.production(s, d), "Line_3", "Night"), f"SELECT {_sum('Target_Qty')} AS Target, {_sum('Actual_Qty')} AS Actual, {_sum('Good_Qty')} AS Good, {_sum('Reject_Qty')} AS Reject, {_pct('sum(Good_Qty)', 'sum(Actual_Qty)')} AS Good_pct, {_pct('sum(Reject_Qty)', 'sum(Actual_Qty)')} AS Reject_pct FROM v_production WHERE Line = 'Line_3' AND Shift = 'Night'")
_add("line_daily", lambda s, d: dashboard.line_daily(views.production(s, d)), f"SELECT Date, Line, {_sum('Actual_Qty')} AS Actual, {_sum('Target_Qty')} AS Target FROM v_production GROUP BY ALL")
_add("product_totals", lambda s, d: dashboard.product_totals(views.production(s, d)), f"SELECT Product, {_sum('Actual_Qty')} AS Actual, {_sum('Target_Qty')} AS Target FROM v_production GROUP BY ALL")
_add("shift_performance", lambda s, d: dashboard.shift_performance(views.production(s, d)), f"SELECT Date, Shift, {_sum('Actual_Qty')} AS Actual, {_sum('Target_Qty')} AS Target, {_sum('Reject_Qty')} AS Reject, {_pct('sum(Actual_Qty)', 'sum(Target_Qty)', 1)} AS Achievement_pct FROM v_production GROUP BY Date, Shift")
_add("defect_heatmap", lambda s, d: dashboard.defect_heatmap(views.quality(s, d), TYPES), "SELECT Product, " + ", ".join(f"CAST(coalesce(sum(Defect_Count) FILTER (Defect_Type = '{t}'), 0) AS BIGINT) AS {t}" for t in TYPES) + " FROM v_quality GROUP BY Product")
_add("modal_status", lambda s, d: dashboard.modal_status(views.machine(s, d)), "SELECT Machine_ID, Status FROM (SELECT Machine_ID, Status, row_number() OVER (PARTITION BY Machine_ID ORDER BY count(*) DESC, Status) AS n FROM d_mach GROUP BY Machine_ID, Status) WHERE n = 1")
_add("pareto", lambda s, d: dashboard.pareto(kpi.defects_by_type(views.quality(s, d))), "SELECT Defect_Type, Total_Defects, round(sum(Total_Defects) OVER (ORDER BY Total_Defects DESC, Defect_Type ROWS UNBOUNDED PRECEDING) * 100e0 / sum(Total_Defects) OVER (), 1) AS Cumulative_pct FROM k_type")
_add("abc_classes", lambda s, d: dashboard.abc_classes(views.inventory(s, d)), "SELECT * FROM w_abc2")
_add("abc_counts", lambda s, d: dashboard.abc_counts(dashboard.abc_classes(views.inventory(s, d))), "SELECT Class, count(*) AS Products, round(sum(Stock_Value), 2) AS Stock_Value FROM w_abc2 GROUP BY Class")
_add("worst_machine", lambda s, d: dashboard.worst_machine(kpi.machine_utilization(views.machine(s, d))), "SELECT Machine_ID, Total_Downtime, Utilization_pct FROM k_util WHERE Date = (SELECT max(Date) FROM k_util) ORDER BY Total_Downtime DESC, Machine_ID LIMIT 1")
_add("machines_by_downtime", lambda s, d: dashboard.machines_by(kpi.machine_utilization(views.machine(s, d)), "Total_Downtime"), "SELECT Machine_ID, Total_Downtime FROM k_util WHERE Date = (SELECT max(Date) FROM k_util)")
_add("machines_by_utilization", lambda s, d: dashboard.machines_by(kpi.machine_utilization(views.machine(s, d)), "Utilization_pct"), "SELECT Machine_ID, Utilization_pct FROM k_util WHERE Date = (SELECT max(Date) FROM k_util)")
_add("oee_gap", lambda s, d: dashboard.oee_gap(_oee(s, d)), "SELECT Date, OEE_pct, round(OEE_pct - 85, 2) AS Gap FROM k_oee")
_add("last_30_days", lambda s, d: dashboard.last_days(kpi.daily_production(views.production(s, d)), 30).select("Date", "Total_Actual"), "SELECT Date, Total_Actual FROM k_daily ORDER BY Date DESC LIMIT 30")
_add("latest_kpi_row", lambda s, d: dashboard.latest_row(kpi.daily_production(views.production(s, d))), "SELECT * FROM d_day")
_add("line_quality", lambda s, d: dashboard.line_quality(views.production(s, d)), f"SELECT Line, count(*) AS Rows, {_sum('Actual_Qty')} AS Produced, {_sum('Reject_Qty')} AS Defects, round((sum(Actual_Qty) - sum(Reject_Qty)) / CAST(nullif(sum(Actual_Qty), 0) AS DOUBLE), 4) AS Quality FROM v_production GROUP BY Line")
_add("rows_per_day", lambda s, d: dashboard.rows_per_day({n: f(s, d) for n, f in DATASETS.items()}), " UNION ALL ".join(f"SELECT Date, count(*) AS Rows, '{n}' AS Dataset FROM {v} GROUP BY Date" for n, v in _VIEW_OF.items()))
_SAVE = "SELECT process, department, before_min - after_min AS saved_min, (before_min - after_min) * frequency_per_week AS saved_week, round((before_min - after_min) * frequency_per_week * 4.33e0, 4) AS saved_month, round((before_min - after_min) * 100 / before_min, 1) AS gain_pct, round((before_min - after_min) * frequency_per_week * 4.33e0 / 60 * cost_per_hour, 2) AS cost_month FROM v_process"
_add("process_savings", lambda s, d: dashboard.process_savings(inputs.view(s, d, "v_process")), _SAVE)
_add("savings_summary", lambda s, d: dashboard.savings_summary(dashboard.process_savings(inputs.view(s, d, "v_process"))), f"SELECT count(*) AS processes, round(sum(saved_month) / 60, 1) AS hours_month, round(sum(cost_month), 2) AS cost_month, round(avg(gain_pct), 1) AS avg_gain_pct FROM ({_SAVE})")
_add("process_upsert", lambda s, d: dashboard.upsert(inputs.view(s, d, "v_process"), inputs.view(s, d, "v_process").filter("frequency_per_week = 2").withColumn("after_min", F.lit(1.0)), "process"), "SELECT process, department, before_min, CASE WHEN frequency_per_week = 2 THEN 1e0 ELSE after_min END AS after_min, frequency_per_week, cost_per_hour FROM v_process")

# --- alerts and report ------------------------------------------------------------------------------
def _alerts(s: SparkSession, d: str) -> DataFrame:
    return alerts.check_all(kpi.daily_production(views.production(s, d)), views.inventory(s, d), views.machine(s, d), _oee(s, d), F.lit(NOW).cast("timestamp"))


_add("alerts", _alerts, "SELECT * FROM a_all")
_add("alerts_critical", lambda s, d: alerts.of_level(_alerts(s, d), "critical"), "SELECT * FROM a_all WHERE level = 'CRITICAL'")
_add("alerts_first", lambda s, d: alerts.prioritised(_alerts(s, d), 5), "SELECT * FROM a_first")
_add("alert_summary", lambda s, d: alerts.summary(_alerts(s, d)), "SELECT 'total' AS kind, 'all' AS name, count(*) AS alerts FROM a_all UNION ALL SELECT 'level', level, count(*) FROM a_all GROUP BY level UNION ALL SELECT 'category', category, count(*) FROM a_all GROUP BY category")
_DEC = "CAST(CAST(round({}, 1) AS DECIMAL(18,1)) AS VARCHAR)"
_add("findings", lambda s, d: report.findings(kpi.daily_production(views.production(s, d)), _oee(s, d), _alerts(s, d)), f"SELECT 'problem' AS kind, 'Achievement at ' || {_DEC.format('Achievement_Rate_pct')} || '%, below 90%' AS text, 'High' AS severity FROM d_day WHERE Achievement_Rate_pct < 90 UNION ALL SELECT 'recommendation', 'Review line schedules and shift allocation', 'High' FROM d_day WHERE Achievement_Rate_pct < 90 UNION ALL SELECT 'problem', 'Reject rate at ' || {_DEC.format('Reject_Rate_pct')} || '%, above 5%', 'High' FROM d_day WHERE Reject_Rate_pct > 5 UNION ALL SELECT 'recommendation', 'Analyse the root causes of the main defects', 'High' FROM d_day WHERE Reject_Rate_pct > 5 UNION ALL SELECT 'problem', 'OEE at ' || {_DEC.format('OEE_pct')} || '%, below 85%', 'Medium' FROM d_oee WHERE OEE_pct < 85 UNION ALL SELECT 'recommendation', 'Reduce downtime and changeover times', 'Medium' FROM d_oee WHERE OEE_pct < 85 UNION ALL SELECT 'problem', message, CASE level WHEN 'CRITICAL' THEN 'High' ELSE 'Medium' END FROM a_first UNION ALL SELECT 'risk', 'Demand may fluctuate', 'Low'")


def _facts(s: SparkSession, d: str) -> DataFrame:
    return report.facts(kpi.daily_production(views.production(s, d)), _oee(s, d), views.machine(s, d), kpi.defects_by_type(views.quality(s, d)), kpi.inventory_kpi(views.inventory(s, d)))


_FACTS = "SELECT y.Date AS last_date, y.Total_Actual, y.Achievement_Rate_pct, y.Reject_Rate_pct, o.OEE_pct, (SELECT coalesce(string_agg(DISTINCT Machine_ID, ',' ORDER BY Machine_ID), '') FROM d_mach WHERE Status = 'Failure') AS failed_machines, (SELECT coalesce(string_agg(DISTINCT Machine_ID, ',' ORDER BY Machine_ID), '') FROM d_mach WHERE Downtime_min > 30) AS down_machines, (SELECT Defect_Type FROM k_type ORDER BY Total_Defects DESC, Defect_Type LIMIT 1) AS top_defect, i.Total_Stock, i.Products_Below_Reorder FROM d_day y, d_oee o, (SELECT * FROM k_inv ORDER BY Date DESC LIMIT 1) i"
_add("report_facts", _facts, _FACTS)
_add("report_row", lambda s, d: report.report_row(gate.decision(gate.evaluate(s, {n: f(s, d) for n, f in DATASETS.items()}, {})), _facts(s, d)), f"SELECT 'ok' AS report, 'GOOD' AS status, '' AS failed, * FROM ({_FACTS})")
_add("canned_questions", lambda s, d: report.canned(kpi.machine_utilization(views.machine(s, d)), kpi.daily_production(views.production(s, d)), kpi.defects_by_type(views.quality(s, d)), kpi.inventory_kpi(views.inventory(s, d))), "SELECT 'machine' AS question, Machine_ID AS subject, CAST(Total_Downtime AS DOUBLE) AS value FROM (SELECT * FROM k_util WHERE Date = (SELECT max(Date) FROM k_util) ORDER BY Total_Downtime DESC, Machine_ID LIMIT 1) UNION ALL SELECT 'production', CAST(Date AS VARCHAR), Total_Actual FROM d_day UNION ALL SELECT 'defect', Defect_Type, Total_Defects FROM (SELECT * FROM k_type ORDER BY Total_Defects DESC, Defect_Type LIMIT 1) UNION ALL SELECT 'inventory', CAST(Date AS VARCHAR), Total_Stock FROM (SELECT * FROM k_inv ORDER BY Date DESC LIMIT 1)")
_CITED = "(SELECT DISTINCT claim_id, unnest([a, b]) AS source_id FROM v_claims)"
_add("rejected_citations", lambda s, d: report.rejected_citations(inputs.view(s, d, "v_claims").select("claim_id", F.array("a", "b").alias("cited")), inputs.view(s, d, "v_claims").select(F.col("a").alias("source_id"))), f"SELECT claim_id, count(*) FILTER (source_id NOT IN (SELECT a FROM v_claims)) AS rejected FROM {_CITED} GROUP BY claim_id")
_add("merged_provenance", lambda s, d: report.merged_provenance(inputs.view(s, d, "v_claims").select("claim_id", F.array("a", "b").alias("x"), F.array("b", "a").alias("y")), "x", "y").select("claim_id", F.array_join("provenance", ",").alias("provenance")), "SELECT claim_id, CASE WHEN a = b THEN a ELSE a || ',' || b END AS provenance FROM v_claims")

# --- the query description --------------------------------------------------------------------------
def _frames(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"daily_production": kpi.daily_production(views.production(s, d)), "machine_utilization": kpi.machine_utilization(views.machine(s, d)), "defect_by_type": kpi.defects_by_type(views.quality(s, d)), "inventory_kpi": kpi.inventory_kpi(views.inventory(s, d))}


_SPEC_TABLE = {"daily_production": "k_daily", "machine_utilization": "k_util", "defect_by_type": "k_type", "inventory_kpi": "k_inv"}
for _name, _spec in spec.SAMPLES.items():
    _fn, _out, _key = {"mean": "avg", "sum": "sum"}[_spec["agg"]], f"{_spec['agg']}_{_spec['metric']}", _spec["group_by"][0]
    _value = _sum(_spec["metric"]) if _fn == "sum" else f"avg({_spec['metric']})"
    _add(f"spec_{_name}", lambda s, d, q=_spec: spec.execute(q, _frames(s, d)), f"SELECT {_key}, {_value} AS {_out} FROM {_SPEC_TABLE[_spec['frame']]} GROUP BY {_key} ORDER BY {_out} DESC NULLS LAST, {_key} LIMIT {_spec['top_n']}")
_add("spec_filtered", lambda s, d: spec.execute({"frame": "machine_utilization", "metric": "Total_Downtime", "group_by": ["Machine_ID"], "agg": "max", "top_n": 7, "filters": [{"column": "Utilization_pct", "op": ">=", "value": 30}, {"column": "Machine_ID", "op": "not in", "value": ["M-01", "M-02"]}]}, _frames(s, d)), "SELECT Machine_ID, max(Total_Downtime) AS max_Total_Downtime FROM k_util WHERE Utilization_pct >= 30 AND Machine_ID NOT IN ('M-01', 'M-02') GROUP BY Machine_ID ORDER BY 2 DESC, 1 LIMIT 7")
_add("spec_global_count", lambda s, d: spec.execute({"frame": "inventory_kpi", "metric": "Total_Stock", "agg": "count", "filters": [{"column": "Products_Below_Reorder", "op": ">", "value": 0}]}, _frames(s, d)), "SELECT count(*) AS Total_Stock FROM k_inv WHERE Products_Below_Reorder > 0 HAVING count(*) > 0")

# --- lineage and ledger -----------------------------------------------------------------------------
_add("lineage_edges", lambda s, d: lineage.clean_edges(inputs.view(s, d, "v_edges")), "SELECT DISTINCT * FROM v_edges WHERE source_dataset <> target_dataset")
_add("lineage_upstream", lambda s, d: lineage.upstream(inputs.view(s, d, "v_edges"), "n22"), "SELECT DISTINCT source_dataset AS dataset FROM v_edges WHERE target_dataset = 'n22'")
_add("lineage_downstream", lambda s, d: lineage.downstream(inputs.view(s, d, "v_edges"), "n22"), "SELECT DISTINCT target_dataset AS dataset FROM v_edges WHERE source_dataset = 'n22'")
_add("lineage_closure", lambda s, d: lineage.closure(inputs.view(s, d, "v_edges")), "SELECT * FROM t_clos")
_add("lineage_ancestors", lambda s, d: lineage.ancestors(inputs.view(s, d, "v_edges"), "n22"), "SELECT ancestor AS dataset FROM t_clos WHERE descendant = 'n22'")
_add("lineage_descendants", lambda s, d: lineage.descendants(inputs.view(s, d, "v_edges"), "n22"), "SELECT descendant AS dataset FROM t_clos WHERE ancestor = 'n22'")
#: Every tenth customer's last order leads back to the first one.
_RETURN = "SELECT 'n' || CAST(max_by(o_orderkey, k) AS STRING) AS source_dataset, 'n' || CAST(min_by(o_orderkey, k) AS STRING) AS target_dataset FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) AS ranked WHERE o_custkey % 10 = 0 GROUP BY o_custkey HAVING count(*) > 1"
inputs.SQL["v_return"] = _RETURN
_BACK = "SELECT source_dataset, target_dataset FROM v_edges UNION SELECT source_dataset, target_dataset FROM v_return"
_add("lineage_cycles", lambda s, d: lineage.cycles(inputs.view(s, d, "v_edges").select("source_dataset", "target_dataset").union(inputs.view(s, d, "v_return"))).select("dataset"), f"SELECT DISTINCT a AS dataset FROM (WITH RECURSIVE b AS ({_BACK}), c AS (SELECT source_dataset AS a, target_dataset AS z FROM b UNION SELECT c.a, b.target_dataset FROM c JOIN b ON c.z = b.source_dataset) SELECT a FROM c WHERE a = z)")


def _catalog(s: SparkSession, d: str) -> DataFrame:
    """A catalog entry for each data set of the edges, with what it is made from."""
    e = inputs.view(s, d, "v_edges")
    names = e.select(F.col("source_dataset").alias("name")).union(e.select("target_dataset")).distinct()
    made_from = e.groupBy(F.col("target_dataset").alias("name")).agg(F.array_sort(F.collect_set("source_dataset")).alias("source"))
    n = F.substring("name", 2, 9).cast("int")
    rows = names.join(made_from, "name", "left").withColumn("n", n)
    return rows.filter("n % 7 != 0").select("name", F.when(n % 5 == 0, "LAKE").when(n < 10, "RAW").when(n < 20, "SILVER").otherwise("GOLD").alias("zone"), F.when(n % 11 == 0, "").otherwise("team").alias("owner"), F.coalesce("source", F.array().cast("array<string>")).alias("source"), F.array().cast("array<string>").alias("consumers"))


_NAMES = "(SELECT source_dataset AS name FROM v_edges UNION SELECT target_dataset FROM v_edges)"
_add("catalog_problems", lambda s, d: lineage.catalog_problems(_catalog(s, d)), f"SELECT name, 'missing owner' AS problem FROM {_NAMES} WHERE CAST(substr(name, 2) AS INT) % 7 <> 0 AND CAST(substr(name, 2) AS INT) % 11 = 0 UNION ALL SELECT name, 'bad zone LAKE' FROM {_NAMES} WHERE CAST(substr(name, 2) AS INT) % 7 <> 0 AND CAST(substr(name, 2) AS INT) % 5 = 0 UNION ALL SELECT DISTINCT target_dataset, 'dangling source ' || source_dataset FROM v_edges WHERE CAST(substr(target_dataset, 2) AS INT) % 7 <> 0 AND CAST(substr(source_dataset, 2) AS INT) % 7 = 0")
_add("catalog_edges", lambda s, d: lineage.catalog_edges(_catalog(s, d)), "SELECT DISTINCT source_dataset, target_dataset, 'catalog' AS transform FROM v_edges WHERE CAST(substr(target_dataset, 2) AS INT) % 7 <> 0")
_add("catalog_listing", lambda s, d: lineage.listing(_catalog(s, d)), f"SELECT name, CASE WHEN n % 5 = 0 THEN 'LAKE' WHEN n < 10 THEN 'RAW' WHEN n < 20 THEN 'SILVER' ELSE 'GOLD' END AS zone FROM (SELECT name, CAST(substr(name, 2) AS INT) AS n FROM {_NAMES}) WHERE n % 7 <> 0")
_add("canonical_attempt", lambda s, d: ledger.canonical_attempts(inputs.view(s, d, "v_attempts")), "SELECT run_id, stage, attempt, status, n AS attempt_count FROM (SELECT *, coalesce(min(attempt) FILTER (status = 'SUCCEEDED') OVER w, max(attempt) OVER w) AS c, count(*) OVER w AS n FROM v_attempts WINDOW w AS (PARTITION BY run_id, stage)) WHERE attempt = c")
_add("illegal_transitions", lambda s, d: ledger.illegal_transitions(inputs.view(s, d, "v_history")), "SELECT run_id, stage, seq, f AS from_status, status AS to_status FROM (SELECT *, lag(status) OVER (PARTITION BY run_id, stage ORDER BY seq) AS f FROM v_history) WHERE CASE WHEN f IS NULL THEN status <> 'PENDING' ELSE f || '>' || status NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in ledger.ALLOWED) + ") END")
_add("expired_leases", lambda s, d: ledger.expired_leases(inputs.view(s, d, "v_ledger"), LATER), f"SELECT * FROM v_ledger WHERE status = 'RUNNING' AND lease_until <= TIMESTAMP '{LATER}'")
_add("failure_disposition", lambda s, d: ledger.after_failure(inputs.view(s, d, "v_failures")), "SELECT *, CASE WHEN error_code IN ('TimeoutError', 'OperationalError') THEN 'TRANSIENT' ELSE 'PERMANENT' END AS failure_class, CASE WHEN error_code IN ('TimeoutError', 'OperationalError') AND attempt < 5 THEN 'RETRY' ELSE 'DEAD_LETTER' END AS disposition FROM v_failures")
_add("dispositions", lambda s, d: ledger.dispositions(inputs.view(s, d, "v_deliveries"), inputs.view(s, d, "v_ledger"), NOW), "SELECT * FROM s_disp")
_add("outcome_counters", lambda s, d: ledger.outcome_counters(ledger.dispositions(inputs.view(s, d, "v_deliveries"), inputs.view(s, d, "v_ledger"), NOW)), "SELECT count(*) AS received, count(*) FILTER (disposition = 'PROCESS') AS completed, count(*) FILTER (disposition = 'ACK_DUPLICATE') AS duplicates, count(*) FILTER (disposition = 'DEFER') AS deferred, count(*) FILTER (disposition = 'RETRY') AS retried, count(*) FILTER (disposition = 'DEAD_LETTER') AS dead_lettered FROM s_disp")

# --- telemetry --------------------------------------------------------------------------------------
def _messages(s: SparkSession, d: str) -> DataFrame:
    return telemetry.with_duplicates(telemetry.checked(telemetry.parsed(inputs.view(s, d, "v_messages"))), ["event_id"])


_add("telemetry_status", lambda s, d: _messages(s, d).select("event_id", "message_id", "status", "reason"), "SELECT * FROM m_done")
_add("telemetry_manifest", lambda s, d: telemetry.manifest(_messages(s, d), "run-1", "ts"), "SELECT 'run-1' AS run_id, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'duplicate_skipped') AS duplicate_skipped, (SELECT min(ts) FROM v_messages) AS started_at, (SELECT max(ts) FROM v_messages) AS completed_at, count(*) || '-' || " + " || '-' || ".join(f"CAST(sum(CAST(('0x' || substr(sha256(message_id || chr(31) || status), {i}, 16)) AS UBIGINT)::HUGEINT) AS VARCHAR)" for i in (1, 17)) + " AS checksum FROM m_done")
_add("telemetry_known_ids", lambda s, d: telemetry.with_duplicates(telemetry.checked(telemetry.parsed(inputs.view(s, d, "v_messages"))), ["event_id"], inputs.view(s, d, "v_messages").filter("event_id % 4 = 1").select(F.col("event_id").cast("string").alias("message_id"))).groupBy("status").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN status = 'duplicate_skipped' OR message_id IN (SELECT CAST(event_id AS VARCHAR) FROM v_messages WHERE event_id % 4 = 1) THEN 'duplicate_skipped' ELSE status END AS status, count(*) AS n FROM m_done GROUP BY 1")
_CODES = "CASE event_id % 12 WHEN 0 THEN 'ENVELOPE_JSON_INVALID' WHEN 1 THEN 'ENVELOPE_NOT_OBJECT' WHEN 2 THEN 'ENVELOPE_VERSION_MISSING' WHEN 3 THEN 'ENVELOPE_VERSION_UNSUPPORTED' WHEN 4 THEN 'ENVELOPE_FIELD_MISSING' WHEN 5 THEN 'ENVELOPE_FIELD_TOO_LONG' WHEN 6 THEN 'ENVELOPE_RUN_ID_MALFORMED' WHEN 7 THEN 'ENVELOPE_STAGE_UNKNOWN' WHEN 8 THEN 'ENVELOPE_PAYLOAD_INVALID' WHEN 9 THEN 'ENVELOPE_TIMESTAMP_INVALID' WHEN 10 THEN 'ENVELOPE_TIMESTAMP_NAIVE' END"
_add("envelope_codes", lambda s, d: inputs.view(s, d, "v_envelopes").select("event_id", telemetry.envelope_code(F.col("body")).alias("code")), f"SELECT event_id, {_CODES} AS code FROM v_envelopes")
_add("envelope_summary", lambda s, d: telemetry.safe_summary(inputs.view(s, d, "v_envelopes").filter(telemetry.envelope_code(F.col("body")).isNull())), "SELECT 'm' || CAST(event_id AS VARCHAR) AS message_id, 's' AS source_id, 'run-0190a5b2-1c3d-7e4f-8a9b-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, 'c' AS correlation_id, 'GOLD' AS stage, 7 AS payload_bytes FROM events WHERE event_id % 12 = 11")
_WIN = "SELECT time_bucket(INTERVAL 15 SECONDS, ts) - i * INTERVAL 15 SECONDS AS start, time_bucket(INTERVAL 15 SECONDS, ts) - i * INTERVAL 15 SECONDS + INTERVAL 5 MINUTES AS \"end\", project, status, latency_ms FROM v_log, range(20) AS r(i)"
_add("error_ratio_5m", lambda s, d: telemetry.error_ratio(views.request_log(s, d)), f"SELECT start, \"end\", project, count(*) AS requests, round(count(*) FILTER (status >= 500) / CAST(count(*) AS DOUBLE), 4) AS ratio, count(*) FILTER (status >= 500) / CAST(count(*) AS DOUBLE) > 0.05 AS alert FROM ({_WIN}) GROUP BY start, \"end\", project")
_add("latency_p95_5m", lambda s, d: telemetry.slow_windows(views.request_log(s, d), most_ms=90.0), f"SELECT start, \"end\", project, quantile_disc(latency_ms, 0.95) AS p95_ms, quantile_disc(latency_ms, 0.95) > 90 AS alert FROM ({_WIN}) GROUP BY start, \"end\", project")

# --- request log and masking ------------------------------------------------------------------------
_POS = "list_sort(list(latency_ms))[CAST(floor(count(*) * {}) AS INT) + 1]"
_add("reqlog_stats", lambda s, d: reqlog.project_stats(views.request_log(s, d)), f"SELECT project, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, round(count(*) FILTER (status >= 400) / CAST(count(*) AS DOUBLE), 3) AS error_rate, CAST(floor((sum(greatest(prompt_chars, 0)) + sum(greatest(completion_chars, 0))) / 4) AS BIGINT) AS est_tokens, count(DISTINCT model) AS models, round(floor((sum(greatest(prompt_chars, 0)) + sum(greatest(completion_chars, 0))) / 4) / 1e6 * 10, 4) AS usd_saved, {_POS.format(0.5)} AS p50_ms, {_POS.format(0.95)} AS p95_ms FROM v_log GROUP BY project")
_add("reqlog_endpoint", lambda s, d: reqlog.endpoint_latency(views.request_log(s, d)), f"SELECT endpoint, round(avg(latency_ms), 4) AS mean_ms, {_POS.format(0.95)} AS p95_ms FROM v_log GROUP BY endpoint")
_add("tokens_by_model", lambda s, d: reqlog.tokens_by_model(views.request_log(s, d)), f"SELECT model, {_sum('coalesce(total_tokens, 0)')} AS tokens FROM v_log GROUP BY model")
_add("failures_by_project", lambda s, d: reqlog.failures_by_project(views.request_log(s, d)), "SELECT project, count(*) AS failures FROM v_log WHERE status >= 400 GROUP BY project")
_add("requests_by_project", lambda s, d: reqlog.requests_by_project(views.request_log(s, d)), "SELECT project, count(*) AS requests FROM v_log GROUP BY project")
_add("slowest_requests", lambda s, d: reqlog.slowest(views.request_log(s, d)), "SELECT id, project, latency_ms FROM v_log ORDER BY latency_ms DESC NULLS LAST, id LIMIT 10")
_add("latency_histogram", lambda s, d: reqlog.latency_histogram(views.request_log(s, d), [0.01, 0.02, *reqlog.BUCKETS]), "SELECT project, " + ", ".join(f"count(*) FILTER (latency_ms / 1000 <= {b!r}) AS {f'le_{b:g}'.replace('.', '_')}" for b in [0.01, 0.02, *reqlog.BUCKETS]) + ", count(latency_ms) AS le_inf, round(sum(latency_ms / 1000), 4) AS sum_s, count(latency_ms) AS count FROM v_log GROUP BY project")
_add("quota_running", lambda s, d: reqlog.quota_usage(views.request_log(s, d), QUOTA), f"SELECT event_id, project, day, tokens, CAST(u AS BIGINT) AS used, u > {QUOTA} AS over_quota FROM (SELECT *, sum(tokens) OVER (PARTITION BY project, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS u FROM l_tok)")
_ALIASES = [("fast", "small-1"), ("reasoning", "large-1"), ("embed", "embed-1")]
_add("model_routing", lambda s, d: reqlog.routed(inputs.view(s, d, "v_requests"), s.createDataFrame(_ALIASES, "alias string, target string"), "default-1", "vision-1"), "SELECT event_id, model, task, has_image, CASE WHEN task = 'embed' THEN 'embed-1' WHEN has_image AND lower(coalesce(model, '')) IN ('', 'fast', 'reasoning', 'general', 'default', 'auto') THEN 'vision-1' WHEN lower(model) = 'fast' THEN 'small-1' WHEN lower(model) = 'reasoning' THEN 'large-1' WHEN coalesce(model, '') <> '' AND lower(model) <> 'auto' THEN model ELSE 'default-1' END AS resolved FROM v_requests")
_DOCS = "SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN ' 0912345678 and 123456789012, 123456789' ELSE '' END AS text FROM documents"
_MASK = "regexp_replace(regexp_replace(regexp_replace(text, '(?:\\+84[\\s.\\-]*|0)(?:3|5|7|8|9)(?:[\\s.\\-]*[0-9]){8}\\b', '[REDACTED_PII]', 'g'), '\\b[0-9]{12}\\b', '[REDACTED_PII]', 'g'), '(^|[^0-9])[0-9]{9}($|[^0-9])', '\\1[REDACTED_PII]\\2', 'g')"
# a match takes the character after it, which the next number needs before it: a second pass finds that one
_MASK = f"regexp_replace({_MASK}, '(^|[^0-9])[0-9]{{9}}($|[^0-9])', '\\1[REDACTED_PII]\\2', 'g')"


def _texts(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", "source", F.concat("text", F.when(F.col("doc_id") % 10 == 0, " 0912345678 and 123456789012, 123456789").otherwise("")).alias("text"))


_add("pii_mask_documents", lambda s, d: _texts(s, d).select("doc_id", F.sha2(masking.masked(F.col("text")), 256).alias("masked_sha"), masking.redactions(F.col("text")).alias("redactions")), f"SELECT doc_id, sha256({_MASK}) AS masked_sha, CAST(len(string_split({_MASK}, '[REDACTED_PII]')) - 1 AS INTEGER) AS redactions FROM ({_DOCS})")
_add("pii_mask_messages", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.concat("text", F.lit(" 0912345678")).alias("content")))).alias("m")).select("conv_id", F.sha2(F.array_join(F.transform(masking.masked_messages(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))), lambda x: x["content"]), "\n"), 256).alias("masked_sha")), "SELECT conv_id, sha256(string_agg(text || ' [REDACTED_PII]', chr(10) ORDER BY turn)) AS masked_sha FROM conversations GROUP BY conv_id")
_add("prompt_fingerprints", lambda s, d: reqlog.prompt_fingerprint(s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text"), "text").drop("text"), "SELECT conv_id, turn, length(text) AS prompt_chars, substr(sha256(text), 1, 16) AS prompt_sha FROM conversations")

# --- tables about tables ----------------------------------------------------------------------------
_add("dataset_listing", lambda s, d: files.listing({n: f(s, d) for n, f in DATASETS.items()}), " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS rows, {len(c)} AS columns FROM {_VIEW_OF[n]}" for n, c in {"production": views.PRODUCTION, "quality": views.QUALITY, "inventory": ["Date", "Product", *views.INVENTORY], "machine": views.MACHINE, "workers": views.WORKERS}.items()))
_add("column_profile", lambda s, d: files.profile(views.raw_production(s, d)), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{'bigint' if c == 'rid' else 'string'}' AS type, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM v_raw" for c in views.RAW_PRODUCTION))
_add("fingerprint_check", lambda s, d: files.verify(files.fingerprint({"a": views.machine(s, d), "b": views.workers(s, d)}), files.fingerprint({"a": views.machine(s, d), "b": views.workers(s, d).withColumn("Units_Produced", F.col("Units_Produced") + 1), "c": views.machine(s, d)})), "SELECT 'a' AS dataset, 'ok' AS result UNION ALL SELECT 'b', 'mismatch' UNION ALL SELECT 'c', 'missing'")


def _days(s: SparkSession, d: str) -> DataFrame:
    silver, curated = views.production(s, d).select("Date", F.lit(True).alias("in_silver")).distinct(), gold.oee_daily(views.production(s, d)).select("Date", F.lit(True).alias("in_gold"))
    return silver.join(curated, "Date", "full_outer").select("Date", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_silver", "in_gold")])


_add("days_covered", _days, "SELECT coalesce(p.Date, g.Date) AS Date, p.Date IS NOT NULL AS in_silver, g.Date IS NOT NULL AS in_gold FROM (SELECT DISTINCT Date FROM v_production) p FULL OUTER JOIN g_oee g ON p.Date = g.Date")

# --- features and models ----------------------------------------------------------------------------
_add("defect_features", lambda s, d: ml.defect_features(views.production(s, d), views.quality(s, d)), f"SELECT p.Date, p.Line, p.Shift, Target_Qty, Actual_Qty, Good_Qty, Reject_Qty, Cycle_Time_sec, Machines, coalesce(Defects, 0) AS Defects, coalesce(Inspected, 0) AS Inspected, coalesce(Critical_Count, 0) AS Critical_Count, coalesce(round(Actual_Qty / CAST(nullif(Target_Qty, 0) AS DOUBLE), 6), 0) AS Achievement, coalesce(round(Reject_Qty / CAST(nullif(Actual_Qty, 0) AS DOUBLE), 6), 0) AS Reject_Rate, coalesce(round(Defects / CAST(nullif(Inspected, 0) AS DOUBLE), 6), 0) AS Defect_Ratio, CASE WHEN coalesce(round(Reject_Qty / CAST(nullif(Actual_Qty, 0) AS DOUBLE), 6), 0) > 0.05 THEN 1 ELSE 0 END AS label FROM (SELECT Date, Line, Shift, {_sum('Target_Qty')} AS Target_Qty, {_sum('Actual_Qty')} AS Actual_Qty, {_sum('Good_Qty')} AS Good_Qty, {_sum('Reject_Qty')} AS Reject_Qty, avg(Cycle_Time_sec) AS Cycle_Time_sec, count(DISTINCT Machine_ID) AS Machines FROM v_production GROUP BY ALL) p LEFT JOIN (SELECT Date, Line, {_sum('Defect_Count')} AS Defects, {_sum('Inspected_Qty')} AS Inspected, count(*) FILTER (Severity = 'Critical') AS Critical_Count FROM v_quality GROUP BY ALL) q ON p.Date = q.Date AND p.Line = q.Line")
_add("downtime_features", lambda s, d: ml.downtime_features(views.machine(s, d)), "SELECT Reading, Date, Machine_ID, Line, Temperature_C, Vibration_mm, Power_Usage_pct, Speed_RPM, CAST((dayofweek(Date) + 6) % 7 AS INTEGER) AS Day_Of_Week, CASE WHEN Status = 'Failure' THEN 1 ELSE 0 END AS is_failure, CASE WHEN Downtime_min > 0 THEN 1 ELSE 0 END AS label FROM v_machine")


def _written_split(features: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Train and test rows out of features that are written once: limits, indexers and trees read those a dozen times."""
    return ml.split(scratch.written(features, "features"), key)


def _rf(s: SparkSession, d: str) -> DataFrame:
    train, test = _written_split(ml.defect_features(views.production(s, d), views.quality(s, d)), ["Date", "Line", "Shift"])
    return ml.metrics(ml.defect_model(train).transform(test))


def _gbt(s: SparkSession, d: str) -> DataFrame:
    train, test = _written_split(ml.downtime_features(views.machine(s, d)), ["Reading"])
    return ml.confusion(ml.downtime_model(train).transform(test))


_add("rf_metrics", _rf)
_add("gbt_confusion", _gbt)

from forgeline.plans import file_queries  # noqa: E402, F401  it adds its queries to these
