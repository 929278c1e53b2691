"""Factory tables out of the star schema: expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TARGET = "(CAST(floor(l_quantity) AS INT) * 10)"
_ACTUAL = f"CAST(floor({_TARGET} * (100 - CAST(floor(l_discount * 100 + 0.5) AS INT)) / 100) AS INT)"
_REJECT = f"CAST(floor({_ACTUAL} * CAST(floor(l_tax * 100 + 0.5) AS INT) / 100) AS INT)"
_LINE = "'Line_' || CAST(1 + {} % 10 AS STRING)"

PRODUCTION = {
    "Date": "CAST(l_shipdate AS DATE)",
    "OEE_Date": "DATE '2023-12-30' + CAST(l_orderkey % 31 AS INT)",
    "Line": _LINE.format("l_suppkey"),
    "Shift": "CASE l_linenumber % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' ELSE 'Night' END",
    "Product": "p_brand",
    "Machine_ID": "'M-' || lpad(CAST(1 + l_partkey % 20 AS STRING), 2, '0')",
    "Worker_ID": "'EMP_' || lpad(CAST(1 + l_orderkey % 200 AS STRING), 4, '0')",
    "Target_Qty": _TARGET,
    "Actual_Qty": _ACTUAL,
    "Good_Qty": f"({_ACTUAL} - {_REJECT})",
    "Reject_Qty": _REJECT,
    "Cycle_Time_sec": "CAST(30 + l_partkey % 90 AS DOUBLE) + 0.5e0",
}
QUALITY = {
    "Date": "CAST(l_shipdate AS DATE)",
    "Product": "p_brand",
    "Line": _LINE.format("l_suppkey"),
    "Defect_Type": "p_type",
    "Defect_Count": "CAST(1 + (l_orderkey + l_linenumber) % 9 AS INT)",
    "Inspected_Qty": "CAST(floor(l_quantity) AS INT) + 100",
    "Severity": "CASE l_returnflag WHEN 'N' THEN 'Minor' WHEN 'A' THEN 'Major' ELSE 'Critical' END",
    "Inspector_ID": "'QC_' || CAST(l_suppkey % 50 AS STRING)",
}
MACHINE = {
    "Date": "CAST(ts AS DATE)",
    "Machine_ID": "'M-' || lpad(CAST(1 + user_id % 20 AS STRING), 2, '0')",
    "Status": "CASE WHEN event_type IN ('click', 'view') THEN 'Running' WHEN event_type = 'purchase' THEN 'Idle' WHEN event_type = 'signup' THEN 'Maintenance' ELSE 'Failure' END",
    "Speed_RPM": "CASE WHEN event_type IN ('click', 'view') THEN 92.5e0 ELSE 0e0 END",
    "Temperature_C": "CAST(30 + event_id % 60 AS DOUBLE)",
    "Vibration_mm": "CAST(event_id % 100 AS DOUBLE) / 10e0",
    "Power_Usage_pct": "CAST(event_id % 96 AS DOUBLE)",
    "Downtime_min": "CASE WHEN event_type IN ('signup', 'error') THEN CAST(event_id % 71 AS INT) ELSE 0 END",
    "Line": _LINE.format("user_id"),
    "Reading": "event_id",
}
INVENTORY_ROWS = {
    "Date": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "Product": "p_brand",
    "stock": "CASE WHEN l_returnflag = 'N' THEN CAST(floor(l_quantity) AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "outgoing": "CASE WHEN l_returnflag = 'R' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "supplier": "l_suppkey",
    "p_size": "p_size",
    "p_retailprice": "CAST(p_retailprice AS DOUBLE)",
}
INVENTORY = {
    "Stock_Qty": "CAST(sum(stock) AS BIGINT)",
    "Incoming_Qty": "count(*)",
    "Outgoing_Qty": "CAST(sum(outgoing) AS BIGINT)",
    "Reorder_Point": "CAST(min(p_size) * 2 AS BIGINT)",
    "Max_Capacity": "CAST(max(p_size) * 10 AS BIGINT)",
    "Unit_Price": "min(p_retailprice)",
    "Supplier": "'SUP_' || CAST(min(supplier) AS STRING)",
}
WORKERS = {
    "Date": "CAST(o_orderdate AS DATE)",
    "Worker_ID": "'EMP_' || lpad(CAST(1 + o_custkey % 200 AS STRING), 4, '0')",
    "Line": _LINE.format("o_custkey"),
    "Shift": "CASE o_orderkey % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' ELSE 'Night' END",
    "Hours_Worked": "6e0 + CAST(o_orderkey % 41 AS DOUBLE) / 10e0",
    "Units_Produced": "CAST(floor(o_totalprice / 1000) AS INT)",
    "Defects_Caused": "CAST(o_orderkey % 7 AS INT)",
    "Attendance": "'Present'",
    "Overtime_hrs": "CAST(o_orderkey % 20 AS DOUBLE) / 10e0",
}
REQUEST_LOG = {
    "id": "CAST(event_id AS STRING)",
    "event_id": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "project": "'proj_' || CAST(user_id % 5 AS STRING)",
    "model": "event_type",
    "endpoint": "CASE WHEN event_type = 'view' THEN 'embeddings' ELSE 'chat' END",
    "latency_ms": "CAST(value AS DOUBLE)",
    "prompt_chars": "CAST((event_id * 37) % 4000 AS BIGINT)",
    "completion_chars": "CASE WHEN event_id % 50 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST((event_id * 13) % 2000 AS BIGINT) END",
    "total_tokens": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST((event_id * 11) % 900 AS BIGINT) END",
    "status": "CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 3 = 1 THEN 503 ELSE 400 END",
}
_RID = "(l_orderkey * 10 + l_linenumber)"
RAW_PRODUCTION = {
    "rid": f"CAST({_RID} AS BIGINT)",
    "Date": f"CASE WHEN {_RID} % 211 = 0 THEN '2999-01-01' WHEN {_RID} % 223 = 0 THEN 'not a date' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
    "Line": f"CASE WHEN {_RID} % 101 = 0 THEN '  ' || {PRODUCTION['Line']} || ' ' ELSE {PRODUCTION['Line']} END",
    "Shift": PRODUCTION["Shift"],
    "Product": PRODUCTION["Product"],
    "Machine_ID": PRODUCTION["Machine_ID"],
    "Worker_ID": f"CASE WHEN {_RID} % 103 = 0 THEN NULL ELSE {PRODUCTION['Worker_ID']} END",
    "Target_Qty": f"CASE WHEN {_RID} % 107 = 0 THEN '-5' ELSE CAST({_TARGET} AS STRING) END",
    "Actual_Qty": f"CASE WHEN {_RID} % 109 = 0 THEN NULL WHEN {_RID} % 113 = 0 THEN 'abc' ELSE CAST({_ACTUAL} AS STRING) END",
    "Good_Qty": f"CAST({PRODUCTION['Good_Qty']} AS STRING)",
    "Reject_Qty": f"CASE WHEN {_RID} % 127 = 0 THEN CAST({_ACTUAL} + 1 AS STRING) ELSE CAST({_REJECT} AS STRING) END",
    "Cycle_Time_sec": f"CASE WHEN {_RID} % 131 = 0 THEN 'Infinity' WHEN {_RID} % 137 = 0 THEN 'NaN' ELSE CAST({PRODUCTION['Cycle_Time_sec']} AS STRING) END",
}


def columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


_JOINED = "lineitem JOIN part ON l_partkey = p_partkey"
#: The same views as SQL, to stand before a DuckDB query.
VIEWS_SQL = {
    "v_production": f"SELECT {columns(PRODUCTION)} FROM {_JOINED}",
    "v_quality": f"SELECT {columns(QUALITY)} FROM {_JOINED} WHERE l_linestatus = 'F'",
    "v_machine": f"SELECT {columns(MACHINE)} FROM events",
    "v_inventory": f"SELECT Date, Product, {columns(INVENTORY)} FROM (SELECT {columns(INVENTORY_ROWS)} FROM {_JOINED}) AS x GROUP BY Date, Product",
    "v_workers": f"SELECT {columns(WORKERS)} FROM orders",
    "v_log": f"SELECT {columns(REQUEST_LOG)} FROM events",
    "v_raw": f"SELECT * FROM (SELECT {columns(RAW_PRODUCTION)} FROM {_JOINED}) AS x UNION ALL SELECT * FROM (SELECT {columns(RAW_PRODUCTION)} FROM {_JOINED}) AS y WHERE rid % 97 = 0",
}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their parts. Catalyst broadcasts the parts where their size allows."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part, F.col("l_partkey") == F.col("p_partkey"))


def _select(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_parts(spark, sf_dir), PRODUCTION)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_parts(spark, sf_dir).filter("l_linestatus = 'F'"), QUALITY)


def machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/events.parquet"), MACHINE)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_parts(spark, sf_dir), INVENTORY_ROWS).groupBy("Date", "Product").agg(*[F.expr(e).alias(n) for n, e in INVENTORY.items()])


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/orders.parquet"), WORKERS)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/events.parquet"), REQUEST_LOG)


def raw_production(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """All columns as strings, with dirt in them and some rows twice. `dealt`: by rid, before numbers become texts and rows are doubled, which takes less shuffle."""
    parts = _parts(spark, sf_dir)
    rows = _select(parts.repartition(F.expr(RAW_PRODUCTION["rid"])) if dealt else parts, RAW_PRODUCTION)
    times = F.when(F.col("rid") % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("__time", F.explode(times)).drop("__time")
