"""Queries over files and tables that are written from the given tables into the checkpoint folder, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions import masking
from forgeline.operators import gold, kpi, ml, report
from forgeline.plans import queries as q
from forgeline.sources import files, scratch, views


def _raw_csv(df: DataFrame, folder: str, by: list[str] = (), compression: str = "none") -> str:
    """df as CSV with its texts as they are; with `by` a folder for each of its values."""
    df.write.mode("overwrite").option("header", True).option("compression", compression).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy(*by).csv(folder)
    return folder


# --- reading (S1 to S6, S15, S17) -------------------------------------------------------------------
def _csv_datasets(s: SparkSession, d: str) -> DataFrame:
    """The five data sets as one CSV folder each, found again by their names: rows and columns of each."""
    folder = scratch.new_folder(s, "raw")
    for name, view in q.DATASETS.items():
        _raw_csv(view(s, d), f"{folder}/2024-01-01_{name}")
    found = {r["dataset"]: r["path"] for r in files.discover_files(s, folder).collect()}
    return files.listing({name: files.read_csv(s, path) for name, path in sorted(found.items())})


q.QUERIES["csv_datasets"], q.ORACLE_SQL["csv_datasets"] = _csv_datasets, q.ORACLE_SQL["dataset_listing"]


def _csv_dates(s: SparkSession, d: str) -> DataFrame:
    rows = files.read_csv(s, _raw_csv(views.production(s, d), scratch.new_folder(s, "production")), dates=True)
    return rows.groupBy("Date", "Line", "Shift").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("Actual_Qty").cast("bigint")).alias("actual"), F.sum(F.col("Cycle_Time_sec").cast("double")).alias("cycle"))


q._add("csv_dates", _csv_dates, "SELECT Date, Line, Shift, count(*) AS rows, CAST(sum(Actual_Qty) AS BIGINT) AS actual, sum(Cycle_Time_sec) AS cycle FROM v_production GROUP BY ALL")


def _by_machine(s: SparkSession, d: str, name: str) -> str:
    """The dirty rows, once each, as one CSV file for each machine, in the order of rid and content; content, which follows from the rest, is neither shuffled nor written."""
    folder = scratch.new_folder(s, name)
    dealt = q._dirty(s, d).drop("content").repartition("Machine_ID").withColumn("of", F.col("Machine_ID"))
    rows = dealt.withColumn("content", q._content()).sortWithinPartitions("of", "rid", "content").drop("content")
    return _raw_csv(rows, folder, ["of"])


def _numbered(s: SparkSession, d: str) -> DataFrame:
    return files.read_numbered(s, _by_machine(s, d, "places")).withColumn("content", q._content())


_PLACES = "SELECT rid, content, Machine_ID, row_number() OVER (PARTITION BY Machine_ID ORDER BY rid, content) - 1 AS row_index FROM c_dirty"
q._add("csv_row_places", lambda s, d: _numbered(s, d).select(F.col("rid").cast("bigint").alias("rid"), "content", "Machine_ID", "row_index"), _PLACES)


def _csv_violations(s: SparkSession, d: str) -> DataFrame:
    found = files.validate_csv(s, _by_machine(s, d, "checked"), "production", q.AS_OF)
    return found.select(F.regexp_extract("file", "of=([^/]*)/", 1).alias("machine"), "row_index", "field", "value", "rule")


q._add("csv_violations", _csv_violations, f"SELECT p.Machine_ID AS machine, row_index, field, value, rule FROM c_all JOIN ({_PLACES}) p USING (rid, content)")


def _csv_malformed(s: SparkSession, d: str) -> DataFrame:
    """A CSV file in which every 50th line lacks a cell and every 77th has one too many: whole and broken lines, which together are all of them."""
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.when(F.col("event_id") % 50 != 0, F.col("user_id").cast("string")), F.when(F.col("event_id") % 77 == 0, "extra"))
    folder = scratch.new_folder(s, "broken")
    s.read.parquet(f"{d}/events.parquet").select(line.alias("event_id,event_type,user_id")).write.option("header", True).option("sep", "\x01").csv(folder)
    rows = files.read_numbered(s, folder)
    kept = files.whole(rows).select(F.lit("kept").alias("what"), "event_type")
    bad = files.malformed(rows).select(F.lit("quarantined").alias("what"), F.split("value", ",")[1].alias("event_type"))
    return kept.unionByName(bad).groupBy("what", "event_type").agg(F.count(F.lit(1)).alias("rows"))


q._add("csv_malformed", _csv_malformed, "SELECT CASE WHEN (event_id % 50 = 0) = (event_id % 77 = 0) THEN 'kept' ELSE 'quarantined' END AS what, event_type, count(*) AS rows FROM events GROUP BY ALL")


def _json_lines(s: SparkSession, d: str) -> DataFrame:
    """The request log as JSON lines, of which every 40th is cut short and every 90th has a text for a number."""
    log = views.request_log(s, d)
    text = F.to_json(F.struct("id", "project", "status", "latency_ms"))
    line = F.when(F.col("event_id") % 40 == 0, F.substring(text, 1, 20)).when(F.col("event_id") % 90 == 0, F.regexp_replace(text, '"status":[0-9]+', '"status":"many"')).otherwise(text)
    folder = scratch.new_folder(s, "log")
    log.select(line.alias("value")).write.text(folder)
    good, bad = files.scan_json_lines(s, folder, "id string, project string, status int, latency_ms double")
    known = good.groupBy("project").agg(F.count(F.lit(1)).alias("rows"), F.sum("status").alias("statuses"))
    return known.unionByName(bad.groupBy(F.col("reason").alias("project")).agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("statuses")))


q._add("json_lines", _json_lines, "SELECT CASE WHEN event_id % 40 = 0 OR event_id % 90 = 0 THEN 'malformed_json' ELSE project END AS project, count(*) AS rows, CAST(sum(CASE WHEN event_id % 40 = 0 OR event_id % 90 = 0 THEN 0 ELSE status END) AS BIGINT) AS statuses FROM v_log GROUP BY 1")


# --- writing (S7 to S13, S16, S21) ------------------------------------------------------------------
def _exports(s: SparkSession, d: str) -> DataFrame:
    """Machine readings as Parquet and as gzip CSV: the rows that writing observed, and what is read again."""
    folder, out = scratch.new_folder(s, "silver"), None
    for form in ("parquet", "csv"):
        n = files.export_silver(views.machine(s, d), f"{folder}/{form}", form)
        back = s.read.parquet(f"{folder}/{form}") if form == "parquet" else files.read_csv(s, f"{folder}/{form}")
        part = back.agg(F.lit(form).alias("form"), F.lit(n).alias("observed"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("Downtime_min").cast("bigint")).alias("downtime"), F.count_distinct("Machine_ID").alias("machines"))
        out = part if out is None else out.unionByName(part)
    return out


q._add("silver_exports", _exports, " UNION ALL ".join(f"SELECT '{f}' AS form, count(*) AS observed, count(*) AS rows, CAST(sum(Downtime_min) AS BIGINT) AS downtime, count(DISTINCT Machine_ID) AS machines FROM v_machine" for f in ("parquet", "csv")))


def _gold_manifest(s: SparkSession, d: str) -> DataFrame:
    tables = {"gold_oee_daily": gold.oee_daily(views.production(s, d)), "gold_quality_daily": gold.quality_daily(views.quality(s, d))}
    return files.export_gold(s, tables, scratch.new_folder(s, "gold"))


q._add("gold_manifest", _gold_manifest, "SELECT 'gold_oee_daily' AS name, (SELECT count(*) FROM g_oee) AS rows, 12 AS columns UNION ALL SELECT 'gold_quality_daily', (SELECT count(*) FROM g_qual), 12")


def _mart_tables(s: SparkSession, d: str) -> DataFrame:
    """The OEE mart as a table, written twice, and one that there isn't; the table goes again."""
    name = f"mart_oee_{uuid.uuid4().hex}"
    mart = scratch.cut(gold.mart(gold.oee_daily(views.production(s, d)), "mart_oee"))
    try:
        for _ in range(2):
            files.write_marts({name: mart})
        counts = scratch.cut(files.mart_row_counts(s, [name, f"{name}_absent"]))
    finally:
        s.sql(f"DROP TABLE IF EXISTS {name}")
    return counts.select(F.when(F.col("mart") == name, "mart_oee").otherwise("absent").alias("mart"), "rows")


q._add("mart_tables", _mart_tables, "SELECT 'mart_oee' AS mart, count(*) AS rows FROM g_oee UNION ALL SELECT 'absent', -1")


def _quarantine_reruns(s: SparkSession, d: str) -> DataFrame:
    """A run's quarantine written twice, another run's once: each run's rows by field and rule."""
    folder, rows = scratch.new_folder(s, "quarantine"), scratch.written(q._quarantined(s, d), "found")
    for run in ("run-1", "run-2", "run-1"):
        files.write_quarantine(rows, folder, run, "production")
    return s.read.parquet(folder).groupBy("run_id", "dataset", "field", "rule").agg(F.count(F.lit(1)).alias("rows"))


q._add("quarantine_reruns", _quarantine_reruns, "SELECT r AS run_id, 'production' AS dataset, field, rule, count(*) AS rows FROM c_all, (VALUES ('run-1'), ('run-2')) AS v(r) GROUP BY ALL")


def _report_files(s: SparkSession, d: str) -> DataFrame:
    folder = scratch.new_folder(s, "report")
    files.export_report({"daily": kpi.daily_production(views.production(s, d))}, folder)
    return files.read_csv(s, f"{folder}/daily").select(F.col("Date").cast("date").alias("Date"), *[F.col(c).cast("bigint").alias(c) for c in ("Total_Actual", "Total_Target", "Records")])


q._add("report_files", _report_files, "SELECT Date, Total_Actual, Total_Target, Records FROM k_daily")


def _etl_run(s: SparkSession, d: str) -> DataFrame:
    """The dirty production rows, as gzip CSV, through the whole file run, twice: what is cleaned, and what is quarantined."""
    folder = scratch.new_folder(s, "etl")
    _raw_csv(q._once(s, d), f"{folder}/raw/production", [], "gzip")
    for _ in range(2):
        done = files.run_etl(s, f"{folder}/raw", f"{folder}/out", "run-1", q.AS_OF)["production"]
    cleaned = done.groupBy("Line").agg(F.lit("cleaned").alias("what"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("Actual_Qty").cast("bigint")).alias("actual"))
    rejected = s.read.parquet(f"{folder}/out/quarantine").groupBy(F.col("rule").alias("Line")).agg(F.lit("quarantined").alias("what"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("actual"))
    return cleaned.unionByName(rejected)


q._add("etl_run", _etl_run, f"SELECT trim(Line) AS Line, 'cleaned' AS what, count(*) AS rows, CAST(sum(CAST(Actual_Qty AS BIGINT)) AS BIGINT) AS actual FROM c_dirty JOIN ({q._GOOD}) g USING (rid, content) GROUP BY 1 UNION ALL SELECT rule, 'quarantined', count(*), 0 FROM c_all GROUP BY rule")


# --- evidence, fingerprints, splits -----------------------------------------------------------------
def _all_kpis(s: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    p, m, w, i, x = (f(s, d) for f in (views.production, views.machine, views.workers, views.inventory, views.quality))
    made = {
        "daily_production": (kpi.daily_production(p), ["Date"]),
        "weekly_production": (kpi.weekly_production(p), ["Year", "Week"]),
        "monthly_production": (kpi.monthly_production(p), ["Year", "Month"]),
        "oee": (q._oee(s, d), ["Date"]),
        "machine_utilization": (kpi.machine_utilization(m), ["Date", "Machine_ID"]),
        "worker_productivity": (kpi.worker_productivity(w), ["Date", "Worker_ID", "Line", "Shift"]),
        "inventory_kpi": (kpi.inventory_kpi(i), ["Date"]),
        "defect_by_type": (kpi.defects_by_type(x), ["Defect_Type"]),
        "defect_by_severity": (kpi.defects_by_severity(x), ["Severity"]),
        "defect_daily": (kpi.defects_daily(x), ["Date"]),
    }
    return {n: df for n, (df, _) in made.items()}, {n: keys for n, (_, keys) in made.items()}


_KPI_ORACLE = {"daily_production": "daily_production", "weekly_production": "weekly_production", "monthly_production": "monthly_production", "oee": "oee", "machine_utilization": "machine_utilization", "worker_productivity": "worker_productivity", "inventory_kpi": "inventory_kpi", "defect_by_type": "defects_by_type", "defect_by_severity": "defects_by_severity", "defect_daily": "defects_daily"}
_KPI_COLUMNS = {
    "daily_production": ("Date", "Date Total_Target Total_Actual Total_Good Total_Reject Avg_Cycle_Time. Records Achievement_Rate_pct. Reject_Rate_pct. Yield_Rate_pct."),
    "weekly_production": ("Year DESC, Week", "Year Week Total_Target Total_Actual Total_Good Total_Reject Avg_Cycle_Time. Achievement_Rate_pct. Reject_Rate_pct."),
    "monthly_production": ("Year DESC, Month", "Year Month Total_Target Total_Actual Total_Good Total_Reject Avg_Cycle_Time. Achievement_Rate_pct. Reject_Rate_pct."),
    "oee": ("Date", "Date Total_Time Downtime_Total Availability_pct. Performance_pct. Quality_pct. OEE_pct."),
    "machine_utilization": ("Date DESC, Machine_ID", "Date Machine_ID Running_Count Idle_Count Maintenance_Count Failure_Count Total_Downtime Avg_Temperature. Avg_Vibration. Avg_Power. Total_Readings Utilization_pct."),
    "worker_productivity": ("Date DESC, Worker_ID DESC, Line DESC, Shift", "Date Worker_ID Line Shift Total_Hours. Total_Units Total_Defects Total_Overtime. Units_Per_Hour. Defect_Rate_pct."),
    "inventory_kpi": ("Date", "Date Total_Stock Total_Incoming Total_Outgoing Avg_Stock. Min_Stock Products_Below_Reorder Stock_Value."),
    "defect_by_type": ("Defect_Type", "Defect_Type Total_Defects Total_Inspected Occurrences Defect_Rate_pct."),
    "defect_by_severity": ("Severity", "Severity Total_Defects Occurrences"),
    "defect_daily": ("Date", "Date Total_Defects Total_Inspected Defect_Rate_pct."),
}


def _kpi_row_sql(name: str) -> str:
    """The last row of a KPI's oracle as the same JSON; columns that end with a point are doubles."""
    order, columns = _KPI_COLUMNS[name]
    cell = lambda c: f"CAST(CAST({c[:-1]} AS DECIMAL(38,4)) AS VARCHAR)" if c.endswith(".") else f"CAST({c} AS VARCHAR)"
    cells = ", ".join(f"'\"{c.rstrip('.')}\":\"' || {cell(c)} || '\"'" for c in sorted(columns.split(), key=lambda c: c.rstrip(".")))
    return f"(SELECT '{{' || concat_ws(',', {cells}) || '}}' FROM ({q.ORACLE_SQL[_KPI_ORACLE[name]]}) ORDER BY {order} DESC NULLS LAST LIMIT 1)"


_EVIDENCE = " UNION ALL ".join([f"SELECT 'kpi:{n}' AS source_id, {_kpi_row_sql(n)} AS row" for n in _KPI_COLUMNS] + [f"SELECT 'dataset:{n}', NULL" for n in q.DATASETS])
q._add("kpi_evidence", lambda s, d: report.evidence(*_all_kpis(s, d), list(q.DATASETS)), f"SELECT source_id, row, 'snap-' || substr(sha256((SELECT string_agg(source_id || '=' || coalesce(row, ''), chr(10) ORDER BY source_id) FROM ({_EVIDENCE}))), 1, 16) AS snapshot_id FROM ({_EVIDENCE})")


def _fingerprint_sql(name: str, view: str, columns: dict[str, str]) -> str:
    cell = lambda c, e: f"CAST(round({c}, 4)::DECIMAL(38,4) AS VARCHAR)" if "DOUBLE" in e or "e0" in e or e.startswith("min(p_retail") else f"CAST({c} AS VARCHAR)"
    line = " || '|' || ".join(f"coalesce({cell(c, columns[c])}, '~')" for c in sorted(columns))
    return f"SELECT '{name}' AS dataset, count(*) AS rows, {len(columns)} AS columns, CAST(coalesce(sum(CAST('0x' || substr(md5({line}), 1, 15) AS UBIGINT)::HUGEINT), 0) AS VARCHAR) AS content FROM {view}"


_COLUMNS = {"production": views.PRODUCTION, "quality": views.QUALITY, "machine": views.MACHINE, "workers": views.WORKERS, "inventory": {"Date": "", "Product": "", **views.INVENTORY}}
q._add("fingerprint", lambda s, d: files.fingerprint({n: f(s, d) for n, f in q.DATASETS.items()}), " UNION ALL ".join(_fingerprint_sql(n, q._VIEW_OF[n], c) for n, c in _COLUMNS.items()))


def _split(s: SparkSession, d: str) -> DataFrame:
    """The training rows of the downtime features, by a hash of the reading."""
    return ml.split(ml.downtime_features(views.machine(s, d)), ["Reading"])[0].select("Reading", "label")


_HASH = "SELECT Reading, CASE WHEN Downtime_min > 0 THEN 1 ELSE 0 END AS label, CAST('0x' || substr(md5('42|' || CAST(Reading AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM v_machine"
q._add("stratified_split", _split, f"SELECT Reading, label FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY h) AS r, count(*) OVER (PARTITION BY label) AS n FROM ({_HASH})) WHERE r <= ceil(0.8e0 * n)")


def _importances(s: SparkSession, d: str) -> DataFrame:
    train, _ = q._written_split(ml.defect_features(views.production(s, d), views.quality(s, d)), ["Date", "Line", "Shift"])
    return ml.importances(s, ml.defect_model(train, trees=20, depth=6))


q._add("rf_importances", _importances)


# --- masking of request bodies (L8) -----------------------------------------------------------------
_PII = " 0912345678"


def _bodies(s: SparkSession, d: str) -> DataFrame:
    """Conversation turns as request bodies: a message's text, a list of parts, `input` as a text and as a list, and no JSON."""
    turns = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.concat("text", F.lit(_PII)).alias("t"))
    kind = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(5))
    message = lambda content: F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages")))
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("t").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    body = F.when(kind == 0, message(F.col("t"))).when(kind == 1, message(parts)).when(kind == 2, F.to_json(F.struct(F.col("t").alias("input")))).when(kind == 3, F.to_json(F.struct(F.array(F.lit("x"), F.col("t")).alias("input")))).otherwise(F.lit("no json"))
    return turns.select("conv_id", "turn", body.alias("body"))


def _mask_bodies(s: SparkSession, d: str) -> DataFrame:
    found = masking.masked_bodies(_bodies(s, d), "body", ["conv_id", "turn"])
    return found.select("conv_id", "turn", "path", F.sha2("text", 256).alias("sha256"), "redactions")


_BODY = "SELECT conv_id, turn, text || ' [REDACTED_PII]' AS t, (turn + conv_id) % 5 AS kind FROM conversations"
q._add("pii_mask_bodies", _mask_bodies, f"SELECT conv_id, turn, CASE kind WHEN 0 THEN 'messages[0].content' WHEN 1 THEN 'messages[0].content[0].text' WHEN 2 THEN 'input' ELSE 'input[1]' END AS path, sha256(t) AS sha256, 1 AS redactions FROM ({_BODY}) WHERE kind < 4 UNION ALL SELECT conv_id, turn, 'input[0]', sha256('x'), 0 FROM ({_BODY}) WHERE kind = 3")
