"""The gate over whole data sets: checks, state, severity, eligibility."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_DATASETS = ("production", "quality", "inventory", "machine", "workers")
REQUIRED_KPIS = ("daily_production", "oee")
MOST_QUARANTINED = 0.5


def _check(df: DataFrame, name: str, ok: Column, detail: Column, failure: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), ok.alias("ok"), detail.alias("detail"), F.when(~ok, failure).alias("failure"))


def _summed(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def evaluate(spark: SparkSession, datasets: dict[str, DataFrame], kpis: dict[str, DataFrame], counts: DataFrame | None = None, scope: str = "unspecified") -> DataFrame:
    """The checks table: name, ok, detail, failure (what it adds to the reason, if it fails). One aggregate a data set and KPI; nothing runs before the table does.

    `counts` is one row (passed, rejected). Without it, or with a null count of rejected rows, the quarantine check says so, and does not take the rate for zero.
    """
    one = spark.range(1)
    missing = sorted(set(REQUIRED_DATASETS) - set(datasets))
    listed = lambda names: "missing=" + ",".join(names)
    checks = [_check(one, "datasets_present", F.lit(not missing), F.lit(listed(missing) if missing else "all required present"), F.lit("missing required dataset(s): " + ", ".join(missing)))]
    sizes = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in datasets.items() if name in REQUIRED_DATASETS]
    if sizes:
        empty = _summed(sizes).agg(F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("name")))).alias("empty"))
        names = F.array_join("empty", ",")
        checks.append(_check(empty, "datasets_non_empty", F.size("empty") == 0, F.when(F.size("empty") == 0, "all non-empty").otherwise(F.concat(F.lit("empty="), names)), F.concat(F.lit("empty validated dataset(s): "), names)))
    if kpis:
        lacking = sorted(set(REQUIRED_KPIS) - set(kpis))
        checks.append(_check(one, "kpi_inputs_present", F.lit(not lacking), F.lit(listed(lacking) if lacking else "required KPIs present"), F.lit("missing required KPI input(s): " + ", ".join(lacking))))
        parts = []
        for name, df in kpis.items():
            numbers = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
            whole = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long")]
            bad = F.lit(0)
            for c in numbers:
                bad = bad + F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
            for c in whole:
                bad = bad + F.count_if(F.col(c).isNull())
            parts.append(df.agg(F.lit(name).alias("kpi"), bad.cast("long").alias("bad")))
        found = _summed(parts).agg(F.array_sort(F.collect_list(F.when(F.col("bad") > 0, F.col("kpi")))).alias("kpis"))
        names = F.array_join("kpis", ",")
        checks.append(_check(found, "kpi_values_finite", F.size("kpis") == 0, F.when(F.size("kpis") == 0, "no NaN/inf").otherwise(F.concat(F.lit("non-finite="), names)), F.concat(F.lit("non-finite KPI(s): "), names)))
    if counts is None:
        checks.append(_check(one, "quarantine_rate", F.lit(True), F.lit("not_provided"), F.lit("")))
    else:
        rejected = F.col("rejected").cast("double")
        rate = F.coalesce(F.try_divide(rejected, rejected + F.coalesce("passed", F.lit(0))), F.lit(0.0))
        said, known = F.format_string("%.3f", rate), F.col("rejected").isNotNull()
        detail = F.when(known, F.concat(F.lit("rate="), said, F.lit(f" (max={MOST_QUARANTINED}, scope={scope})"))).otherwise("not_provided")
        checks.append(_check(counts, "quarantine_rate", F.when(known, rate <= MOST_QUARANTINED).otherwise(True), detail, F.concat(F.lit("quarantine rate "), said, F.lit(f" exceeds {MOST_QUARANTINED}"))))
    return _summed(checks)


def judged(spark: SparkSession, evaluation: Callable[[], DataFrame]) -> DataFrame:
    """The decision over the checks that `evaluation` makes, worked out here. An error in making or running them gives UNKNOWN with its kind and text, never GOOD."""
    try:
        checks = evaluation()
        return spark.createDataFrame(decision(checks).collect(), DECISION)
    except Exception as error:  # noqa: BLE001  whatever fails, the gate stays shut
        said = f"quality evaluation error: {type(error).__name__}: {error}"[:500]
        return spark.createDataFrame([("UNKNOWN", 0, "", said)], DECISION)


def evidence(datasets: dict[str, DataFrame], date_col: str = "Date") -> DataFrame:
    """(dataset, rows, first_date, last_date): what the checks were made on; one aggregate a data set."""
    out = None
    for name, df in datasets.items():
        part = df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))
        out = part if out is None else out.unionByName(part)
    return out


DECISION = "status string, checks bigint, failed string, reason string"


def decision(checks: DataFrame) -> DataFrame:
    """One row: GOOD if every check holds, else BAD, UNKNOWN if one couldn't be judged; with the failed checks and the reason (500 characters at most)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("name", "failure"))))
    unknown = F.count_if(F.col("ok").isNull()) > 0
    reason = F.when(unknown, "a check could not be judged").when(F.size(failed) == 0, "all checks passed").otherwise(F.left(F.array_join(F.transform(failed, lambda x: x["failure"]), "; "), F.lit(500)))
    status = F.when(unknown, "UNKNOWN").when(F.coalesce(F.bool_and("ok"), F.lit(False)), "GOOD").otherwise("BAD")
    return checks.agg(status.alias("status"), F.count(F.lit(1)).alias("checks"), F.array_join(F.transform(failed, lambda x: x["name"]), ",").alias("failed"), reason.alias("reason"))


def state_and_severity(results: DataFrame) -> DataFrame:
    """By run, from rule results (run_id, passed, blocking, severity): state, severity, counts, validity, eligibility.

    A failed blocking rule makes a run BAD, and its severity WARNING at least. A run whose results hold a
    null `passed` can't be measured: UNKNOWN without a severity. Only GOOD is eligible.
    """
    failing = F.count_if(F.col("blocking") & ~F.col("passed"))
    unknown = F.count_if(F.col("passed").isNull()) > 0
    critical, warning = F.count_if(F.col("severity") == "CRITICAL"), F.count_if(F.col("severity") == "WARNING")
    state = F.when(unknown, "UNKNOWN").when(failing > 0, "BAD").otherwise("GOOD")
    severity = F.when(unknown, None).when(failing > 0, F.when(critical > 0, "CRITICAL").otherwise("WARNING")).otherwise(F.when(warning > 0, "WARNING").otherwise("NONE"))
    out = results.groupBy("run_id").agg(state.alias("state"), severity.alias("severity"), failing.alias("blocking_failures"), warning.alias("warnings"), critical.alias("criticals"))
    contradictory = (F.col("state") == "GOOD") & (F.col("criticals") > 0)
    return out.select("*", (~contradictory).alias("valid"), ((F.col("state") == "GOOD") & ~contradictory).alias("eligible"))


def quarantine_ratio(n_raw: DataFrame, n_kept: DataFrame, most: float = 0.25) -> DataFrame:
    """One row: dropped and kept counts (column n of each), their ratio to the raw rows, and whether it is at most `most`."""
    both = n_raw.select(F.col("n").alias("raw")).join(F.broadcast(n_kept.select(F.col("n").alias("kept"))))
    ratio = F.round(F.try_divide((F.col("raw") - F.col("kept")).cast("double"), F.col("raw").cast("double")), 4)
    return both.select((F.col("raw") - F.col("kept")).alias("dropped"), "kept", ratio.alias("ratio")).withColumn("ok", F.coalesce(F.col("ratio"), F.lit(0.0)) <= most)


def end_of_run(oee_mart: DataFrame) -> DataFrame:
    """One row: the mart has rows, the reject rate lies in 0..0.30, good and reject don't exceed actual."""
    s = oee_mart.agg(F.count(F.lit(1)).alias("rows"), F.sum("Total_Actual").alias("actual"), F.sum("Total_Good").alias("good"), F.sum("Total_Reject").alias("reject"))
    rate = F.try_divide(F.col("reject").cast("double"), F.col("actual").cast("double"))
    return s.select("rows", F.round(rate, 4).alias("reject_rate"), (F.col("rows") > 0).alias("mart_not_empty"), rate.between(0, 0.30).alias("reject_rate_ok"), (F.col("good") + F.col("reject") <= F.col("actual")).alias("balance_ok"))
