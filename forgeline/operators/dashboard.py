"""Rankings, shares, running totals and pivots for the dashboards, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeline.functions.columns import percent, ratio_from_one
from forgeline.operators.gold import latest, running

STATUSES = ("Running", "Idle", "Maintenance", "Failure")


def slice_of(df: DataFrame, line: str = "All", shift: str = "All") -> DataFrame:
    for column, value in (("Line", line), ("Shift", shift)):
        df = df if value == "All" else df.filter(F.col(column) == value)
    return df


def worker_ranking(df: DataFrame) -> DataFrame:
    out = df.groupBy("Worker_ID").agg(F.round(F.sum("Hours_Worked"), 6).alias("Hours"), F.sum("Units_Produced").alias("Units"), F.sum("Defects_Caused").alias("Defects"))
    return out.select("*", F.round(ratio_from_one(F.col("Units"), F.col("Hours")), 1).alias("Units_Per_Hour"), F.round(ratio_from_one(F.col("Defects") * 100, F.col("Units")), 1).alias("Defect_pct"))


def top_workers(df: DataFrame, n: int = 10) -> DataFrame:
    return worker_ranking(df).orderBy(F.desc("Units_Per_Hour"), "Worker_ID").limit(n)


def status_share(df: DataFrame) -> DataFrame:
    """Readings of each status on the last date, with their share of all."""
    counts = latest(df).groupBy("Status").agg(F.count(F.lit(1)).alias("Readings"))
    return counts.withColumn("Share_pct", F.round(F.col("Readings") * 100.0 / F.sum("Readings").over(Window.partitionBy(F.lit(1))), 1))


def production_totals(df: DataFrame, line: str = "All", shift: str = "All") -> DataFrame:
    out = slice_of(df, line, shift).agg(F.sum("Target_Qty").alias("Target"), F.sum("Actual_Qty").alias("Actual"), F.sum("Good_Qty").alias("Good"), F.sum("Reject_Qty").alias("Reject"))
    return out.select("*", percent(F.col("Good"), F.col("Actual")).alias("Good_pct"), percent(F.col("Reject"), F.col("Actual")).alias("Reject_pct"))


def line_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("Date", "Line").agg(F.sum("Actual_Qty").alias("Actual"), F.sum("Target_Qty").alias("Target"))


def product_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("Product").agg(F.sum("Actual_Qty").alias("Actual"), F.sum("Target_Qty").alias("Target")).orderBy("Actual", "Product")


def shift_performance(df: DataFrame) -> DataFrame:
    out = df.groupBy("Date", "Shift").agg(F.sum("Actual_Qty").alias("Actual"), F.sum("Target_Qty").alias("Target"), F.sum("Reject_Qty").alias("Reject"))
    return out.withColumn("Achievement_pct", percent(F.col("Actual"), F.col("Target"), 1))


def defect_heatmap(df: DataFrame, types: list[str]) -> DataFrame:
    """Defects of each product in a column for each of `types`, 0 where there are none."""
    out = df.groupBy("Product").pivot("Defect_Type", types).agg(F.sum("Defect_Count"))
    return out.na.fill(0)


def modal_status(df: DataFrame) -> DataFrame:
    """The most frequent status of each machine on the last date; of equally frequent ones the first by name."""
    counts = latest(df).groupBy("Machine_ID", "Status").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("Machine_ID").agg(F.max("n").alias("n"))
    return counts.join(best, ["Machine_ID", "n"]).groupBy("Machine_ID").agg(F.min("Status").alias("Status"))


def pareto(by_type: DataFrame) -> DataFrame:
    """Running share of all defects, the most frequent type first. The input has one row a type."""
    order = [F.desc("Total_Defects"), F.col("Defect_Type")]
    return by_type.select("Defect_Type", "Total_Defects", F.round(F.sum("Total_Defects").over(running(order)) * 100.0 / F.sum("Total_Defects").over(Window.partitionBy(F.lit(1))), 1).alias("Cumulative_pct"))


def abc_classes(inventory: DataFrame) -> DataFrame:
    """Products of the last date by running share of stock value: A up to 70, B up to 90, else C. One row a product."""
    value = latest(inventory).withColumn("Stock_Value", F.round(F.col("Stock_Qty") * F.col("Unit_Price"), 2))
    order = [F.desc("Stock_Value"), F.col("Product")]
    share = F.round(F.sum("Stock_Value").over(running(order)) * 100.0 / F.sum("Stock_Value").over(Window.partitionBy(F.lit(1))), 2)
    out = value.select("Product", "Stock_Value", share.alias("Cumulative_pct"))
    return out.withColumn("Class", F.when(F.col("Cumulative_pct") <= 70, "A").when(F.col("Cumulative_pct") <= 90, "B").otherwise("C"))


def abc_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("Class").agg(F.count(F.lit(1)).alias("Products"), F.round(F.sum("Stock_Value"), 2).alias("Stock_Value"))


def worst_machine(utilization: DataFrame) -> DataFrame:
    """The machine with the most downtime on the last date."""
    return latest(utilization).orderBy(F.desc("Total_Downtime"), "Machine_ID").limit(1).select("Machine_ID", "Total_Downtime", "Utilization_pct")


def machines_by(utilization: DataFrame, measure: str) -> DataFrame:
    return latest(utilization).select("Machine_ID", measure).orderBy(measure, "Machine_ID")


def oee_gap(oee: DataFrame, target: float = 85.0) -> DataFrame:
    return oee.select("Date", "OEE_pct", F.round(F.col("OEE_pct") - target, 2).alias("Gap"))


def last_days(df: DataFrame, n: int, key: str = "Date") -> DataFrame:
    """The last n rows by `key`, oldest first again."""
    return df.orderBy(F.desc(key)).limit(n).orderBy(key)


def latest_row(df: DataFrame, key: str = "Date") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(key)).limit(1)


def line_quality(df: DataFrame) -> DataFrame:
    out = df.groupBy("Line").agg(F.count(F.lit(1)).alias("Rows"), F.sum("Actual_Qty").alias("Produced"), F.sum("Reject_Qty").alias("Defects"))
    return out.withColumn("Quality", F.round(F.try_divide((F.col("Produced") - F.col("Defects")).cast("double"), F.col("Produced").cast("double")), 4))


def rows_per_day(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows of all data sets by day and data set; each is counted before the union."""
    out = None
    for name, df in datasets.items():
        part = df.groupBy("Date").agg(F.count(F.lit(1)).alias("Rows")).withColumn("Dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def process_savings(df: DataFrame) -> DataFrame:
    """Per process: minutes saved a task, a week, a month of 4.33 weeks, the gain, and the cost saved."""
    saved = F.col("before_min") - F.col("after_min")
    month = saved * F.col("frequency_per_week") * 4.33
    return df.select("process", "department", saved.alias("saved_min"), (saved * F.col("frequency_per_week")).alias("saved_week"), F.round(month, 4).alias("saved_month"), F.round(F.coalesce(F.try_divide(saved * 100.0, F.col("before_min")), F.lit(0.0)), 1).alias("gain_pct"), F.round(month / 60 * F.col("cost_per_hour"), 2).alias("cost_month"))


def savings_summary(savings: DataFrame) -> DataFrame:
    return savings.agg(F.count(F.lit(1)).alias("processes"), F.round(F.sum("saved_month") / 60, 1).alias("hours_month"), F.round(F.sum("cost_month"), 2).alias("cost_month"), F.round(F.avg("gain_pct"), 1).alias("avg_gain_pct"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`table` with its rows of a key in `rows` replaced, and the others of `rows` added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def shifted_copies(df: DataFrame, copies: int, days: int) -> DataFrame:
    """df as often as `copies`, each copy `days` later: an explode, no join."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("Date", F.date_add("Date", (F.col("__copy") * days).cast("int"))).drop("__copy")
