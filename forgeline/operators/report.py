"""Evidence, findings and facts of the daily report, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.operators.alerts import one_decimal, prioritised
from forgeline.operators.dashboard import latest_row, worst_machine
from forgeline.operators.gold import latest
from forgeline.sources.scratch import cut


def evidence(kpis: dict[str, DataFrame], keys: dict[str, list[str]], datasets: list[str] = ()) -> DataFrame:
    """(source_id, row, snapshot_id): kpi:<name> with the last row of each KPI, and dataset:<name> without one; a KPI without rows has none.

    `keys` gives the order of each KPI's rows. A row is JSON of its columns by name, every value as a text, doubles with four digits after the
    point, nulls left out. The snapshot_id is one for the whole evidence, a hash over all its rows by source_id: equal inputs have equal ids.
    """
    parts = []
    for name, df in kpis.items():
        last = df.orderBy(*[F.desc_nulls_last(k) for k in keys[name]]).limit(1)
        text = lambda f: (F.col(f.name).cast("decimal(38,4)") if f.dataType.typeName() in ("double", "float") else F.col(f.name)).cast("string").alias(f.name)
        parts.append(last.select(F.lit(f"kpi:{name}").alias("source_id"), F.to_json(F.struct(*[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])).alias("row")))
    if datasets:
        names = F.array(*[F.lit(f"dataset:{d}") for d in sorted(datasets)])
        parts.append(parts[0].sparkSession.range(1).select(F.explode(names).alias("source_id"), F.lit(None).cast("string").alias("row")))
    rows = cut(reduce(DataFrame.unionByName, parts))  # a row for each source
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", F.coalesce("row", F.lit("")).alias("row")))), lambda x: F.concat_ws("=", x["source_id"], x["row"])), "\n")
    snapshot = rows.agg(F.concat(F.lit("snap-"), F.substring(F.sha2(whole, 256), 1, 16)).alias("snapshot_id"))
    return rows.join(F.broadcast(snapshot))


def rejected_citations(claims: DataFrame, known: DataFrame) -> DataFrame:
    """By claim (claim_id, cited: array<string>): how many cited ids no evidence (source_id) has."""
    cited = claims.select("claim_id", F.explode_outer(F.array_distinct("cited")).alias("source_id"))
    bad = cited.filter("source_id IS NOT NULL").join(known.select("source_id").distinct(), "source_id", "left_anti").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    return claims.select("claim_id").distinct().join(bad, "claim_id", "left").select("claim_id", F.coalesce("n", F.lit(0)).alias("rejected"))


def merged_provenance(df: DataFrame, first: str, second: str) -> DataFrame:
    """Both id lists as one, in order, each id once."""
    return df.withColumn("provenance", F.array_distinct(F.concat(first, second)))


def findings(daily: DataFrame, oee: DataFrame, alerts: DataFrame, n_alerts: int = 5) -> DataFrame:
    """Problems and recommendations by fixed thresholds on the last day, then the first alerts as problems, and the standing risk."""
    day, eff = latest_row(daily), latest_row(oee)
    row = lambda df, cond, kind, text, severity: df.filter(cond).select(F.lit(kind).alias("kind"), text.alias("text"), F.lit(severity).alias("severity"))
    low, rejects, weak = F.col("Achievement_Rate_pct") < 90, F.col("Reject_Rate_pct") > 5, F.col("OEE_pct") < 85
    parts = [
        row(day, low, "problem", F.concat(F.lit("Achievement at "), one_decimal(F.col("Achievement_Rate_pct")), F.lit("%, below 90%")), "High"),
        row(day, low, "recommendation", F.lit("Review line schedules and shift allocation"), "High"),
        row(day, rejects, "problem", F.concat(F.lit("Reject rate at "), one_decimal(F.col("Reject_Rate_pct")), F.lit("%, above 5%")), "High"),
        row(day, rejects, "recommendation", F.lit("Analyse the root causes of the main defects"), "High"),
        row(eff, weak, "problem", F.concat(F.lit("OEE at "), one_decimal(F.col("OEE_pct")), F.lit("%, below 85%")), "Medium"),
        row(eff, weak, "recommendation", F.lit("Reduce downtime and changeover times"), "Medium"),
        prioritised(alerts, n_alerts).filter(F.col("level").isin("CRITICAL", "WARNING")).select(F.lit("problem").alias("kind"), F.col("message").alias("text"), F.when(F.col("level") == "CRITICAL", "High").otherwise("Medium").alias("severity")),
        daily.sparkSession.range(1).select(F.lit("risk").alias("kind"), F.lit("Demand may fluctuate").alias("text"), F.lit("Low").alias("severity")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def facts(daily: DataFrame, oee: DataFrame, machine: DataFrame, by_type: DataFrame, inventory_kpi: DataFrame) -> DataFrame:
    """One row of facts: last production and OEE, failed and often-down machines of the last date, top defect, stock."""
    day = latest_row(daily).select(F.col("Date").alias("last_date"), "Total_Actual", "Achievement_Rate_pct", "Reject_Rate_pct")
    eff = latest_row(oee).select("OEE_pct")
    now = latest(machine).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("Status") == "Failure", F.col("Machine_ID")))), ",").alias("failed_machines"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("Downtime_min") > 30, F.col("Machine_ID")))), ",").alias("down_machines"),
    )
    top = by_type.orderBy(F.desc("Total_Defects"), "Defect_Type").limit(1).select(F.col("Defect_Type").alias("top_defect"))
    stock = latest_row(inventory_kpi).select("Total_Stock", "Products_Below_Reorder")
    out = day
    for one in (eff, now, top, stock):
        out = out.join(F.broadcast(one))
    return out


def report_row(decision: DataFrame, facts_row: DataFrame) -> DataFrame:
    """The report, or its refusal: only a GOOD decision lets figures through."""
    both = decision.select("status", "failed").join(F.broadcast(facts_row))
    good = F.col("status") == "GOOD"
    return both.select(F.when(good, "ok").otherwise("blocked").alias("report"), "status", "failed", *[F.when(good, F.col(c)).alias(c) for c in facts_row.columns])


def canned(utilization: DataFrame, daily: DataFrame, by_type: DataFrame, inventory_kpi: DataFrame) -> DataFrame:
    """The four standing questions, one row each: question, subject, value."""
    shape = lambda df, q, subject, value: df.select(F.lit(q).alias("question"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))
    out = shape(worst_machine(utilization), "machine", F.col("Machine_ID"), F.col("Total_Downtime"))
    out = out.unionByName(shape(latest_row(daily), "production", F.col("Date"), F.col("Total_Actual")))
    out = out.unionByName(shape(by_type.orderBy(F.desc("Total_Defects"), "Defect_Type").limit(1), "defect", F.col("Defect_Type"), F.col("Total_Defects")))
    return out.unionByName(shape(latest_row(inventory_kpi), "inventory", F.col("Date"), F.col("Total_Stock")))
