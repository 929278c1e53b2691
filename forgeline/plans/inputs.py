"""Tables of ledger, lineage and process rows, and telemetry bodies, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ATTEMPT = "CASE event_type WHEN 'click' THEN 'RETRYABLE' WHEN 'view' THEN 'SUCCEEDED' WHEN 'purchase' THEN 'RUNNING' WHEN 'signup' THEN 'FAILED' ELSE 'RETRYABLE' END"
#: SQL that Spark and DuckDB read alike, over views with the names of the given tables.
SQL = {
    "v_attempts": f"SELECT 'run_' || CAST(user_id % 97 AS STRING) AS run_id, 'stage_' || CAST(user_id % 8 AS STRING) AS stage, CAST(row_number() OVER (PARTITION BY user_id % 97, user_id % 8 ORDER BY ts, event_id) AS INT) AS attempt, {_ATTEMPT} AS status FROM events",
    "v_history": "SELECT 'run_' || CAST(user_id AS STRING) AS run_id, 'stage_0' AS stage, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'signup' THEN 'RETRYABLE' ELSE 'FAILED' END AS status FROM events",
    "v_ledger": "SELECT 'run_' || CAST(user_id AS STRING) AS run_id, 'stage_0' AS stage, CASE max(event_id) % 5 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'FAILED' ELSE 'RETRYABLE' END AS status, max(CAST(ts AS TIMESTAMP)) AS lease_until FROM events GROUP BY user_id HAVING user_id % 3 <> 0",
    "v_deliveries": "SELECT CAST(event_id AS STRING) AS message_id, 'run_' || CAST(user_id AS STRING) AS run_id, 'stage_0' AS stage, CASE WHEN event_id % 41 = 0 THEN 'ENVELOPE_JSON_INVALID' END AS error_code FROM events",
    "v_failures": "SELECT CAST(event_id AS STRING) AS message_id, CASE event_id % 4 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'OperationalError' ELSE 'KeyError' END AS error_code, CAST(1 + event_id % 7 AS INT) AS attempt FROM events WHERE event_type = 'error'",
    # each order of a customer is made into the next one (t1) and the one after that (t2)
    "v_edges": "SELECT 'n' || CAST(o_orderkey AS STRING) AS source_dataset, 'n' || CAST(made AS STRING) AS target_dataset, 't' || CAST(step AS STRING) AS transform FROM ("
    + " UNION ALL ".join(f"SELECT o_orderkey, {k} AS step, lead(o_orderkey, {k}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS made FROM orders" for k in (1, 2))
    + ") AS chains WHERE made IS NOT NULL",
    "v_process": "SELECT 'p' || CAST(s_suppkey AS STRING) AS process, CASE s_nationkey % 2 WHEN 0 THEN 'Quality' ELSE 'Production' END AS department, CAST(20 + 3 * (s_suppkey % 25) AS DOUBLE) AS before_min, CAST(5 + s_suppkey % 25 AS DOUBLE) AS after_min, CAST(1 + s_suppkey % 5 AS INT) AS frequency_per_week, CAST(10 + s_suppkey % 25 AS DOUBLE) AS cost_per_hour FROM supplier",
    "v_rules": "SELECT 'run_' || CAST(user_id % 300 AS STRING) AS run_id, CASE WHEN event_id % 997 = 0 THEN NULL ELSE value > 3 END AS passed, event_id % 4 = 0 AS blocking, CASE WHEN event_id % 31 = 0 THEN 'CRITICAL' WHEN event_id % 5 = 0 THEN 'WARNING' ELSE 'NONE' END AS severity FROM events",
    "v_requests": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'fast' WHEN 1 THEN 'my-model' WHEN 2 THEN '' WHEN 3 THEN 'AUTO' WHEN 4 THEN 'Reasoning' ELSE NULL END AS model, CASE WHEN event_id % 11 = 0 THEN 'embed' WHEN event_id % 13 = 0 THEN 'nothing' END AS task, event_id % 5 = 0 AS has_image FROM events",
    "v_claims": "SELECT event_id AS claim_id, 'ds:' || CAST(user_id % 50 AS STRING) AS a, 'ds:' || CAST(event_id % 70 AS STRING) AS b FROM events",
}
_DAY = "CAST(CAST(ts AS DATE) AS STRING)"
_ID = "CAST(CASE WHEN event_id % 10 = 3 THEN event_id - 1 ELSE event_id END AS STRING)"
_SPEED = "CASE WHEN event_id % 23 = 0 THEN '-5' WHEN event_id % 29 = 0 THEN '\"abc\"' ELSE '92.5' END"
_OPTIONAL = {
    "Line": ("event_id % 19 = 0", "'\"Line_' || CAST(user_id % 10 AS STRING) || '\"'"),
    "Machine_ID": ("event_id % 13 = 0", "'\"M-' || CAST(user_id % 20 AS STRING) || '\"'"),
}
#: Bodies with keys in order; every 17th has no id, some lack mandatory keys, some repeat an id, some speeds are bad.
SQL["v_messages"] = (
    "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, '{\"Date\":\"' || " + _DAY + " || '\"' || "
    + " || ".join(f"CASE WHEN {absent} THEN '' ELSE ',\"{k}\":' || {value} END" for k, (absent, value) in _OPTIONAL.items())
    + " || ',\"Speed_RPM\":' || " + _SPEED + " || CASE WHEN event_id % 17 = 0 THEN '' ELSE ',\"id\":\"' || " + _ID + " || '\"' END || ',\"seq\":' || CAST(event_id AS STRING) || '}' AS body FROM events"
)
_RUN = "'run-0190a5b2-1c3d-7e4f-8a9b-' || lpad(CAST(event_id AS STRING), 12, '0')"
#: Envelopes that are wrong in every way, by the remainder of the event.
SQL["v_envelopes"] = (
    "SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'not json' WHEN 1 THEN '[1]' ELSE '{\"schema_version\":' || CASE event_id % 12 WHEN 2 THEN '\"1\"' WHEN 3 THEN '2' ELSE '1' END"
    " || ',\"message_id\":\"' || CASE event_id % 12 WHEN 4 THEN '' WHEN 5 THEN repeat('x', 129) ELSE 'm' || CAST(event_id AS STRING) END || '\",\"source_id\":\"s\",\"run_id\":\"' || CASE event_id % 12 WHEN 6 THEN 'run-1' ELSE " + _RUN + " END"
    " || '\",\"correlation_id\":\"c\",\"stage\":\"' || CASE event_id % 12 WHEN 7 THEN 'NOWHERE' ELSE 'GOLD' END || '\",\"payload\":' || CASE event_id % 12 WHEN 8 THEN '7' ELSE '{\"a\":1}' END"
    " || CASE event_id % 12 WHEN 9 THEN '' WHEN 10 THEN ',\"occurred_at\":\"2024-01-01T00:00:00\"' ELSE ',\"occurred_at\":\"2024-01-01T00:00:00Z\"' END || '}' END AS body FROM events"
)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of one of the SQL texts, over the given Parquet files."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders", "supplier")}
    text = SQL[name]
    for t, df in tables.items():
        if f"FROM {t}" in text:
            df.createOrReplaceTempView(f"forgeline_{t}")
            text = text.replace(f"FROM {t}", f"FROM forgeline_{t}")
    return spark.sql(text)
