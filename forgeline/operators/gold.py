"""Curated daily tables and marts (ratios by the rule of `ratio_or_null`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.functions.columns import health_status, ratio_or_null, stock_status, warnings

# Columns without which a gold table or a mart can't be built, and the grain and columns of each mart.
REQUIRED = {
    "production": ["Date", "Line", "Machine_ID", "Target_Qty", "Actual_Qty", "Good_Qty", "Reject_Qty", "Cycle_Time_sec"],
    "quality": ["Date", "Product", "Line", "Defect_Type", "Defect_Count", "Inspected_Qty", "Severity"],
    "inventory": ["Date", "Product", "Stock_Qty", "Reorder_Point", "Max_Capacity", "Unit_Price", "Supplier"],
    "machine": ["Date", "Machine_ID", "Status", "Temperature_C", "Vibration_mm", "Downtime_min", "Line"],
}
SEVERITIES = ("Minor", "Major", "Critical")
GRAIN = {"mart_oee": ["Date"], "mart_quality": ["Date"], "mart_inventory": ["Product"]}
MART_REQUIRED = {"mart_oee": ["Date", "Total_Actual", "OEE_pct"], "mart_quality": ["Date", "Total_Defects", "Defect_Rate_pct"], "mart_inventory": ["Product", "Stock_Qty", "Stock_Status"]}
MART_COLUMNS = {
    "mart_oee": ["Date", "Total_Target", "Total_Actual", "Total_Good", "Total_Reject", "Machines", "Availability_pct", "Performance_pct", "Quality_pct", "OEE_pct"],
    "mart_quality": ["Date", "Total_Defects", "Total_Inspected", "Defect_Rate_pct", "Pass_Rate_pct", "Defect_Types", "Products"],
    "mart_inventory": ["Product", "Stock_Qty", "Reorder_Point", "Stock_Value", "Stock_Status", "Snapshot_Date"],
}


def required(df: DataFrame, dataset: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [c for c in REQUIRED[dataset] if c not in df.columns]
    if missing:
        raise ValueError(f"{dataset} lacks columns: {', '.join(missing)}")
    return df


def dated(df: DataFrame) -> DataFrame:
    """Rows whose Date parses."""
    return df.withColumn("Date", F.col("Date").try_cast("date")).filter("Date IS NOT NULL")


def checked(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def with_dates(df: DataFrame, dataset: str) -> DataFrame:
    """The dated rows of a data set that has the required columns; an error if it lacks one or no row's Date parses."""
    return checked(dated(required(df, dataset)), f"{dataset} (rows whose Date parses)")


def latest(df: DataFrame) -> DataFrame:
    """Rows of the last date: one aggregate, sent to every task, and a filter."""
    last = df.agg(F.max("Date").alias("__last"))
    return df.join(F.broadcast(last), F.col("Date") == F.col("__last")).drop("__last")


def _pct(num: Column, den: Column) -> Column:
    return F.round(ratio_or_null(num * F.lit(100.0), den), 2)


def oee_daily(df: DataFrame) -> DataFrame:
    """Availability is 100 by definition here; without a Shift column, rows count as shifts."""
    df = with_dates(df, "production")
    shifts = F.count_distinct("Shift") if "Shift" in df.columns else F.count(F.lit(1))
    out = df.groupBy("Date").agg(
        F.sum("Target_Qty").alias("Total_Target"),
        F.sum("Actual_Qty").alias("Total_Actual"),
        F.sum("Good_Qty").alias("Total_Good"),
        F.sum("Reject_Qty").alias("Total_Reject"),
        F.avg("Cycle_Time_sec").alias("Avg_Cycle_Time"),
        F.count_distinct("Machine_ID").alias("Machines"),
        shifts.alias("Shifts"),
    )
    out = out.select("*", F.lit(100.0).alias("Availability_pct"), _pct(F.col("Total_Actual"), F.col("Total_Target")).alias("Performance_pct"), _pct(F.col("Total_Good"), F.col("Total_Actual")).alias("Quality_pct"))
    return out.withColumn("OEE_pct", F.round(F.col("Performance_pct") * F.col("Quality_pct") / 100, 2))


def quality_daily(df: DataFrame, severities: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """Defects of each severity in a column of its own, all others in Defects_Other; one pass, no pivot job."""
    df = with_dates(df, "quality")
    by = [F.sum(F.when(F.col("Severity") == s, F.col("Defect_Count")).otherwise(0)).alias(f"Defects_{s}") for s in severities]
    other = F.sum(F.when(~F.coalesce(F.col("Severity").isin(*severities), F.lit(False)), F.col("Defect_Count")).otherwise(0)).alias("Defects_Other")
    out = df.groupBy("Date").agg(
        F.sum("Defect_Count").alias("Total_Defects"),
        F.sum("Inspected_Qty").alias("Total_Inspected"),
        F.count_distinct("Defect_Type").alias("Defect_Types"),
        F.count_distinct("Product").alias("Products"),
        F.count_distinct("Line").alias("Lines"),
        *by,
        other,
    )
    rate = ratio_or_null(F.col("Total_Defects") * F.lit(100.0), F.col("Total_Inspected"))
    return out.select("*", F.round(rate, 2).alias("Defect_Rate_pct"), F.round(F.lit(100.0) - rate, 2).alias("Pass_Rate_pct"))


def inventory_snapshot(df: DataFrame) -> DataFrame:
    """The last date's stock, by product. Below reorder means strictly below here."""
    df = latest(with_dates(df, "inventory"))
    pct = _pct(F.col("Stock_Qty"), F.col("Max_Capacity"))
    out = df.select("*", F.round(F.col("Stock_Qty") * F.col("Unit_Price"), 2).alias("Stock_Value"), (F.col("Stock_Qty") < F.col("Reorder_Point")).alias("Below_Reorder"), pct.alias("Capacity_pct"), F.col("Date").alias("Snapshot_Date"))
    return out.withColumn("Stock_Status", stock_status(F.col("Stock_Qty"), F.col("Reorder_Point"), F.col("Capacity_pct"))).orderBy("Product")


def machine_health(df: DataFrame, down_values: tuple[str, ...] = ("DOWN",)) -> DataFrame:
    df = with_dates(df, "machine")
    out = df.groupBy("Date").agg(
        F.count_distinct("Machine_ID").alias("Machines"),
        F.round(F.avg("Temperature_C"), 2).alias("Avg_Temperature"),
        F.round(F.max("Temperature_C"), 2).alias("Max_Temperature"),
        F.round(F.avg("Vibration_mm"), 3).alias("Avg_Vibration"),
        F.round(F.max("Vibration_mm"), 3).alias("Max_Vibration"),
        F.sum("Downtime_min").alias("Total_Downtime"),
        F.count_if(F.col("Status").isin(*down_values)).alias("Down_Count"),
    )
    return out.withColumns({"Warning_Count": warnings(F.col("Max_Temperature"), F.col("Max_Vibration")), "Health_Status": health_status(F.col("Max_Temperature"), F.col("Max_Vibration"))})


def mart(gold: DataFrame, name: str) -> DataFrame:
    """The mart's columns that the gold table has, in the order of the mart's grain; an error if required columns or all rows are missing."""
    missing = [c for c in MART_REQUIRED[name] if c not in gold.columns]
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return checked(gold, name).select(*[c for c in MART_COLUMNS[name] if c in gold.columns]).orderBy(*GRAIN[name])


def single_grain(mart: DataFrame, name: str) -> DataFrame:
    """The mart, or an error that counts the rows whose grain key occurs more than once."""
    repeated = grain_violations(mart, GRAIN[name]).count()
    if repeated:
        raise ValueError(f"{name} has {repeated} rows that share their key {GRAIN[name]}")
    return mart


def grain_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once; counted first, so that only such keys meet the rows."""
    many = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("Rows_In_Key")).filter("Rows_In_Key > 1")
    return df.join(many, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(*df.columns, "Rows_In_Key")


def kpi_summary(oee_mart: DataFrame, quality_mart: DataFrame, inventory_mart: DataFrame) -> DataFrame:
    """One row of eight figures: three global aggregates of one row each."""
    a = oee_mart.agg(F.sum("Total_Actual").alias("total_actual"), F.sum("Total_Reject").alias("total_reject"), F.round(F.avg("OEE_pct"), 2).alias("avg_oee"), F.count(F.lit(1)).alias("days"))
    b = quality_mart.agg(F.sum("Total_Defects").alias("total_defects"), F.round(F.avg("Defect_Rate_pct"), 2).alias("avg_defect_rate"))
    c = inventory_mart.agg(F.count_if(F.col("Stock_Status") != "OK").alias("skus_not_ok"), F.round(F.sum("Stock_Value"), 2).alias("total_stock_value"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def running(order: list[Column]) -> Window:
    """A running frame over all rows: for tables that were aggregated to a few rows only."""
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
