"""Row contracts as column expressions, the quarantine of violations, and the gate between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.functions.columns import safe_cell


@dataclass(frozen=True)
class Field:
    kind: str  # string, int, float, date
    low: float | None = None
    high: float | None = None


_TEXT, _DAY, _COUNT, _AMOUNT, _NUMBER = Field("string"), Field("date"), Field("int", 0), Field("float", 0), Field("float")
CONTRACTS: dict[str, dict[str, Field]] = {
    "production": {"Date": _DAY, "Line": _TEXT, "Shift": _TEXT, "Product": _TEXT, "Machine_ID": _TEXT, "Worker_ID": _TEXT, "Target_Qty": _COUNT, "Actual_Qty": _COUNT, "Good_Qty": _COUNT, "Reject_Qty": _COUNT, "Cycle_Time_sec": _AMOUNT},
    "quality": {"Date": _DAY, "Product": _TEXT, "Line": _TEXT, "Defect_Type": _TEXT, "Defect_Count": _COUNT, "Inspected_Qty": _COUNT, "Severity": _TEXT, "Inspector_ID": _TEXT},
    "inventory": {"Date": _DAY, "Product": _TEXT, "Stock_Qty": _COUNT, "Incoming_Qty": _COUNT, "Outgoing_Qty": _COUNT, "Reorder_Point": _COUNT, "Max_Capacity": _COUNT, "Unit_Price": _AMOUNT},
    "machine": {"Date": _DAY, "Machine_ID": _TEXT, "Status": _TEXT, "Speed_RPM": _NUMBER, "Temperature_C": _NUMBER, "Vibration_mm": _NUMBER, "Power_Usage_pct": _NUMBER, "Downtime_min": _AMOUNT, "Line": _TEXT},
    "workers": {"Date": _DAY, "Worker_ID": _TEXT, "Line": _TEXT, "Shift": _TEXT, "Hours_Worked": Field("float", 0, 24), "Units_Produced": _COUNT, "Defects_Caused": _COUNT, "Attendance": _TEXT, "Overtime_hrs": _AMOUNT},
}
#: (small, large): small must not exceed large.
CROSS = {"production": ("Reject_Qty", "Actual_Qty"), "quality": ("Defect_Count", "Inspected_Qty")}
_SQL = {"string": "string", "int": "bigint", "float": "double", "date": "date"}


def _typed(name: str, field: Field) -> Column:
    """The field's value in the contract's type, null where it has none."""
    raw = F.trim(F.col(name).cast("string"))
    value = raw.try_cast(_SQL[field.kind])
    return F.when(raw.rlike(r"^[+-]?[0-9]+$"), value) if field.kind == "int" else value


def _rule(name: str, field: Field, as_of: Column) -> Column:
    """The rule that a present field breaks, or null. `__v_<name>` holds its typed value."""
    raw, value = F.col(name).cast("string"), F.col(f"__v_{name}")
    rule = F.when(raw.isNull() | (F.trim(raw) == ""), "not_blank")
    if field.kind == "string":
        return rule
    rule = rule.when(value.isNull(), f"type_{field.kind}")
    if field.kind == "float":
        rule = rule.when(F.isnan(value) | (F.abs(value) == float("inf")), "finite")
    if field.low is not None:
        rule = rule.when(value < field.low, "range")
    if field.high is not None:
        rule = rule.when(value > field.high, "range")
    return rule.when(value > as_of, "not_in_future") if field.kind == "date" else rule


def with_violations(df: DataFrame, dataset: str, as_of: str | None = None) -> DataFrame:
    """df with `violations`: array<struct<ord, field, value, rule>> of each row; an unknown data set is an error.

    Three projections: typed values, the rule that each field breaks, the array of what is broken. The rule
    across fields is judged only where every field is good, under the field __model__.
    """
    if dataset not in CONTRACTS:
        raise ValueError(f"unknown data set {dataset!r}; known: {sorted(CONTRACTS)}")
    fields = CONTRACTS[dataset]
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    present = {c: f for c, f in fields.items() if c in df.columns}
    typed = df.withColumns({f"__v_{c}": _typed(c, f) for c, f in present.items() if f.kind != "string"})
    ruled = typed.withColumns({f"__r_{c}": _rule(c, f, today) if c in present else F.lit("missing") for c, f in fields.items()})
    entry = lambda i, name, value, rule: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("field"), value.alias("value"), rule.alias("rule"))
    found = [entry(i, c, F.col(c).cast("string") if c in present else F.lit(None).cast("string"), F.col(f"__r_{c}")) for i, c in enumerate(fields)]
    if dataset in CROSS and all(c in present for c in CROSS[dataset]):
        small, large = CROSS[dataset]
        broken = F.coalesce(*[F.col(f"__r_{c}") for c in fields]).isNull() & (F.col(f"__v_{small}") > F.col(f"__v_{large}"))
        found.append(entry(len(fields), "__model__", F.col(small).cast("string"), F.when(broken, f"{small}_le_{large}")))
    return ruled.select(*[F.col(c) for c in df.columns], F.filter(F.array(*found), lambda x: x["rule"].isNotNull()).alias("violations"))


def violations(df: DataFrame, dataset: str, key: list[str], as_of: str | None = None) -> DataFrame:
    """One row a violation: the row's key, field, value, rule."""
    return _each(with_violations(df, dataset, as_of)).filter("v IS NOT NULL").select(*key, "v.ord", "v.field", "v.value", "v.rule")


def _each(judged: DataFrame) -> DataFrame:
    """A row for each violation `v`; a row without violations once, with a null. A filter on `v` stays above the rules, whereas one on the array
    is pushed below the projections, each of its references with the whole expression."""
    return judged.select("*", F.explode_outer("violations").alias("v")).drop("violations")


def passed(df: DataFrame, dataset: str, as_of: str | None = None) -> DataFrame:
    """Rows without a violation, their fields as the contract's types; other columns stay."""
    return _typed_fields(_each(with_violations(df, dataset, as_of)).filter("v IS NULL").drop("v"), dataset)


def _typed_fields(good: DataFrame, dataset: str) -> DataFrame:
    return good.withColumns({c: F.trim(F.col(c).cast("string")).try_cast(_SQL[f.kind]) for c, f in CONTRACTS[dataset].items()})


def dedup_violations(found: DataFrame, key: list[str]) -> DataFrame:
    """The first violation of each row and field."""
    first = Window.partitionBy(*key, "field").orderBy("ord", "rule", "value")
    return found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def quarantine(found: DataFrame, key: list[str], dataset: str, source_file: str, run_id: str, at: str | None = None) -> DataFrame:
    """Rows for the quarantine table: deduplicated, with every text made safe for spreadsheets."""
    base = F.regexp_extract(F.lit(source_file), r"[^/\\]*$", 0)
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    return dedup_violations(found, key).select(when.alias("quarantined_at"), F.lit(dataset).alias("dataset"), base.alias("source_file"), *key, F.col("field"), safe_cell(F.col("value")).alias("value"), "rule", F.lit(run_id).alias("run_id"))


def quarantine_summary(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy(F.coalesce(F.nullif(F.trim("dataset"), F.lit("")), F.lit("unknown")).alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))


def run_counts(quarantined: DataFrame, run_id: str) -> DataFrame:
    return quarantine_summary(quarantined.filter(F.col("run_id") == run_id))


def gate(df: DataFrame, dataset: str, key: list[str], source_file: str, run_id: str, as_of: str | None = None, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows for the quarantine). An unknown data set passes whole; a failure of the job lets nothing through."""
    if dataset not in CONTRACTS:
        return df, None
    return passed(df, dataset, as_of), quarantine(violations(df, dataset, key, as_of), key, dataset, source_file, run_id, at)


def gate_judged(judged: DataFrame, dataset: str, key: list[str], source_file: str, run_id: str, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As `gate`, for rows that `with_violations` has judged and that were written since, so that both sides read them and no row is judged twice."""
    good = judged.filter(F.size("violations") == 0).drop("violations")
    found = judged.filter(F.size("violations") > 0).select(*key, F.explode("violations").alias("v")).select(*key, "v.ord", "v.field", "v.value", "v.rule")
    return _typed_fields(good, dataset), quarantine(found, key, dataset, source_file, run_id, at)


def quality_context(n_passed: DataFrame, by_dataset: DataFrame, cumulative: DataFrame) -> DataFrame:
    """One row: passed, rejected (null without evidence of this run), scope, cumulative quarantine rows."""
    rejected = by_dataset.agg(F.sum("rows").alias("rejected"), F.map_from_entries(F.collect_list(F.struct("dataset", "rows"))).alias("by_dataset"))
    total = cumulative.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("dlq_cumulative_rows"))
    one = n_passed.agg(F.coalesce(F.sum("passed"), F.lit(0)).alias("passed")).join(F.broadcast(rejected)).join(F.broadcast(total))
    return one.withColumn("scope", F.when(F.col("rejected").isNull(), "not_provided").otherwise("current_run"))
