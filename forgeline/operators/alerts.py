"""Alert rules over KPI and factory tables. An alert: level, category, message, value, threshold, source, timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.operators.dashboard import latest_row
from forgeline.operators.gold import latest

# The limits of the alert rules.
REJECT_RATE, INVENTORY_MIN, DOWNTIME_MIN, OEE_TARGET = 5.0, 200, 30, 85.0
ACHIEVEMENT_MIN, TEMPERATURE_MAX, VIBRATION_MAX = 80.0, 85.0, 8.0


def _alert(when: Column, level: Column | str, category: str, message: Column, value: Column | None, threshold: Column | float | None, source: Column | str) -> Column:
    """The alert of a row for which `when` holds, else null."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.when(when, F.struct(text(level).alias("level"), F.lit(category).alias("category"), message.alias("message"), number(value).alias("value"), number(threshold).alias("threshold"), text(source).alias("source")))


def _raised(df: DataFrame, rules: list[Column]) -> DataFrame:
    """The alerts of all rules from one pass over df."""
    return df.select(F.inline(F.array_compact(F.array(*rules))))


def one_decimal(c: Column) -> Column:
    return F.round(c, 1).cast("decimal(18,1)").cast("string")


def reject_rate() -> Column:
    rate = F.col("Reject_Rate_pct")
    level = F.when(rate < REJECT_RATE * 1.5, "WARNING").otherwise("CRITICAL")
    return _alert(rate > REJECT_RATE, level, "Quality", F.concat(F.lit("Reject rate "), one_decimal(rate), F.lit("% exceeds 5.0%")), rate, REJECT_RATE, "Production")


def achievement() -> Column:
    rate = F.col("Achievement_Rate_pct")
    return _alert(rate < ACHIEVEMENT_MIN, "WARNING", "Production", F.concat(F.lit("Achievement only "), one_decimal(rate), F.lit("%")), rate, ACHIEVEMENT_MIN, "Production")


def low_stock() -> Column:
    stock = F.col("Stock_Qty")
    level = F.when(stock < INVENTORY_MIN * 0.5, "CRITICAL").otherwise("WARNING")
    message = F.concat(F.lit("Low stock of "), "Product", F.lit(": "), stock.cast("string"), F.lit(" left"))
    return _alert(stock <= INVENTORY_MIN, level, "Inventory", message, stock, INVENTORY_MIN, "Inventory")


def reorder() -> Column:
    """At or below the reorder point, unlike the gold table's flag."""
    stock, point = F.col("Stock_Qty"), F.col("Reorder_Point")
    message = F.concat(F.lit("Reorder "), "Product", F.lit(": "), stock.cast("string"), F.lit(" of "), point.cast("string"))
    return _alert(stock <= point, "WARNING", "Inventory", message, stock, point, "Inventory")


def _machine(condition: Column, level: Column | str, message: Column, value: Column | None, threshold: float | None) -> Column:
    return _alert(condition, level, "Machine", F.concat(F.lit("Machine "), F.col("Machine_ID"), F.lit(": "), message), value, threshold, F.concat(F.lit("Machine_"), "Machine_ID"))


def downtime() -> Column:
    d = F.col("Downtime_min")
    return _machine(d > DOWNTIME_MIN, F.when(d > DOWNTIME_MIN * 2, "CRITICAL").otherwise("WARNING"), F.concat(d.cast("string"), F.lit(" min down ("), "Status", F.lit(")")), d, DOWNTIME_MIN)


def failure() -> Column:
    return _machine(F.col("Status") == "Failure", "CRITICAL", F.lit("failure"), None, None)


def temperature() -> Column:
    t = F.col("Temperature_C")
    return _machine((t > TEMPERATURE_MAX) & (F.col("Status") == "Running"), "WARNING", F.concat(F.lit("temperature "), one_decimal(t)), t, TEMPERATURE_MAX)


def vibration() -> Column:
    v = F.col("Vibration_mm")
    return _machine((v > VIBRATION_MAX) & (F.col("Status") == "Running"), "WARNING", F.concat(F.lit("vibration "), one_decimal(v)), v, VIBRATION_MAX)


def low_oee() -> Column:
    o = F.col("OEE_pct")
    return _alert(o < OEE_TARGET, "WARNING", "OEE", F.concat(F.lit("OEE at "), one_decimal(o), F.lit("%")), o, OEE_TARGET, "OEE")


def check_all(daily: DataFrame, inventory: DataFrame, machine: DataFrame, oee: DataFrame, at: Column | None = None) -> DataFrame:
    """All rules' alerts with the time `at` (now, if not given), in no order; `prioritised` sorts them. One pass a table judges all its rules."""
    out = _raised(latest_row(daily), [reject_rate(), achievement()])
    for more in (_raised(latest(inventory), [low_stock(), reorder()]), _raised(latest(machine), [downtime(), failure(), temperature(), vibration()]), _raised(latest_row(oee), [low_oee()])):
        out = out.unionByName(more)
    return out.withColumn("timestamp", at if at is not None else F.current_timestamp())


def priority(level: Column) -> Column:
    return F.when(level == "CRITICAL", 0).when(level == "WARNING", 1).when(level == "INFO", 2).otherwise(3)


def prioritised(alerts: DataFrame, n: int | None = None) -> DataFrame:
    """CRITICAL before WARNING before INFO, then by time, category, source and message; the first n if given."""
    out = alerts.orderBy(priority(F.col("level")), "timestamp", "category", "source", "message")
    return out if n is None else out.limit(n)


def of_level(alerts: DataFrame, level: str) -> DataFrame:
    return alerts.filter(F.col("level") == level.upper())


def summary(alerts: DataFrame) -> DataFrame:
    """Counts in all, by level and by category, from one pass over the alerts (grouping sets)."""
    sets = alerts.groupingSets([["level"], ["category"], []], "level", "category").agg(F.count(F.lit(1)).alias("alerts"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "level").otherwise("category")
    return sets.select(kind.alias("kind"), F.coalesce("level", "category", F.lit("all")).alias("name"), "alerts")
