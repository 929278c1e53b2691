"""KPIs of production, machines, workers, inventory and defects (ratios by the rule of `ratio_or_num`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.functions.columns import percent, ratio_or_num

_SUMS = {"Total_Target": "Target_Qty", "Total_Actual": "Actual_Qty", "Total_Good": "Good_Qty", "Total_Reject": "Reject_Qty"}


def _rates() -> list[Column]:
    actual = F.col("Total_Actual")
    return [
        percent(actual, F.col("Total_Target")).alias("Achievement_Rate_pct"),
        percent(F.col("Total_Reject"), actual).alias("Reject_Rate_pct"),
        percent(F.col("Total_Good"), actual).alias("Yield_Rate_pct"),
    ]


def _production(df: DataFrame, keys: list[Column], count: bool = False) -> DataFrame:
    aggs = [F.sum(c).alias(n) for n, c in _SUMS.items()]
    aggs += [F.avg("Cycle_Time_sec").alias("Avg_Cycle_Time")] + [F.count(F.lit(1)).alias("Records")] * count
    return df.groupBy(*keys).agg(*aggs).select("*", *_rates())


def daily_production(df: DataFrame) -> DataFrame:
    return _production(df, [F.col("Date")], count=True).orderBy("Date")


def weekly_production(df: DataFrame) -> DataFrame:
    """By calendar year and ISO week: 2027-01-01 counts as (2027, 53)."""
    return _production(df, [F.year("Date").alias("Year"), F.weekofyear("Date").alias("Week")]).drop("Yield_Rate_pct")


def monthly_production(df: DataFrame) -> DataFrame:
    return _production(df, [F.year("Date").alias("Year"), F.month("Date").alias("Month")]).drop("Yield_Rate_pct")


def oee(production: DataFrame, machine: DataFrame, minutes_per_reading: int = 10, date_col: str = "Date") -> DataFrame:
    """Availability, performance, quality and their product by day; a day that one side lacks has nulls.

    Each reading stands for `minutes_per_reading`; availability isn't clamped and can be negative. Each
    factor is rounded before the product. Production is grouped once for both of its factors.
    """
    minutes = F.col("Total_Time") * minutes_per_reading
    up = machine.groupBy("Date").agg(F.count("Downtime_min").alias("Total_Time"), F.sum("Downtime_min").alias("Downtime_Total"))
    up = up.withColumn("Availability_pct", percent(minutes - F.col("Downtime_Total"), minutes))
    made = production.groupBy(F.col(date_col).alias("Date")).agg(F.sum("Target_Qty").alias("t"), F.sum("Actual_Qty").alias("a"), F.sum("Good_Qty").alias("g"))
    made = made.select("Date", percent(F.col("a"), F.col("t")).alias("Performance_pct"), percent(F.col("g"), F.col("a")).alias("Quality_pct"))
    product = F.col("Availability_pct") / 100 * (F.col("Performance_pct") / 100) * (F.col("Quality_pct") / 100) * 100
    return up.join(made, "Date", "full_outer").withColumn("OEE_pct", F.round(product, 2))


def machine_utilization(df: DataFrame) -> DataFrame:
    statuses = [F.count_if(F.col("Status") == s).alias(f"{s}_Count") for s in ("Running", "Idle", "Maintenance", "Failure")]
    out = df.groupBy("Date", "Machine_ID").agg(
        *statuses,
        F.sum("Downtime_min").alias("Total_Downtime"),
        F.avg("Temperature_C").alias("Avg_Temperature"),
        F.avg("Vibration_mm").alias("Avg_Vibration"),
        F.avg("Power_Usage_pct").alias("Avg_Power"),
        F.count(F.lit(1)).alias("Total_Readings"),
    )
    return out.withColumn("Utilization_pct", percent(F.col("Running_Count"), F.col("Total_Readings"))).orderBy("Date", "Machine_ID")


def worker_productivity(df: DataFrame) -> DataFrame:
    out = df.groupBy("Date", "Worker_ID", "Line", "Shift").agg(
        F.round(F.sum("Hours_Worked"), 6).alias("Total_Hours"),
        F.sum("Units_Produced").alias("Total_Units"),
        F.sum("Defects_Caused").alias("Total_Defects"),
        F.round(F.sum("Overtime_hrs"), 6).alias("Total_Overtime"),
    )
    return out.select("*", F.round(ratio_or_num(F.col("Total_Units"), F.col("Total_Hours")), 1).alias("Units_Per_Hour"), percent(F.col("Total_Defects"), F.col("Total_Units")).alias("Defect_Rate_pct")).orderBy("Date", "Worker_ID")


def inventory_kpi(df: DataFrame) -> DataFrame:
    return df.groupBy("Date").agg(
        F.sum("Stock_Qty").alias("Total_Stock"),
        F.sum("Incoming_Qty").alias("Total_Incoming"),
        F.sum("Outgoing_Qty").alias("Total_Outgoing"),
        F.avg("Stock_Qty").alias("Avg_Stock"),
        F.min("Stock_Qty").alias("Min_Stock"),
        F.count_if(F.col("Stock_Qty") <= F.col("Reorder_Point")).alias("Products_Below_Reorder"),
        F.round(F.sum(F.col("Stock_Qty") * F.col("Unit_Price")), 2).alias("Stock_Value"),
    )


def defects_by_type(df: DataFrame) -> DataFrame:
    """Most defects first; equal ones by type."""
    out = df.groupBy("Defect_Type").agg(F.sum("Defect_Count").alias("Total_Defects"), F.sum("Inspected_Qty").alias("Total_Inspected"), F.count(F.lit(1)).alias("Occurrences"))
    return out.withColumn("Defect_Rate_pct", percent(F.col("Total_Defects"), F.col("Total_Inspected"))).orderBy(F.desc("Total_Defects"), "Defect_Type")


def defects_by_severity(df: DataFrame) -> DataFrame:
    return df.groupBy("Severity").agg(F.sum("Defect_Count").alias("Total_Defects"), F.count(F.lit(1)).alias("Occurrences"))


def defects_daily(df: DataFrame) -> DataFrame:
    out = df.groupBy("Date").agg(F.sum("Defect_Count").alias("Total_Defects"), F.sum("Inspected_Qty").alias("Total_Inspected"))
    return out.withColumn("Defect_Rate_pct", percent(F.col("Total_Defects"), F.col("Total_Inspected")))


def all_kpis(production: DataFrame, quality: DataFrame, inventory: DataFrame, machine: DataFrame, workers: DataFrame) -> dict[str, DataFrame]:
    """Every KPI table by name, each a lazy plan over the shared inputs."""
    return {
        "daily_production": daily_production(production),
        "weekly_production": weekly_production(production),
        "monthly_production": monthly_production(production),
        "oee": oee(production, machine),
        "machine_utilization": machine_utilization(machine),
        "worker_productivity": worker_productivity(workers),
        "inventory_kpi": inventory_kpi(inventory),
        "defect_by_type": defects_by_type(quality),
        "defect_by_severity": defects_by_severity(quality),
        "defect_daily": defects_daily(quality),
    }
