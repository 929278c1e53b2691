"""Cleaning: coercion, duplicates, imputation, dates, text, negatives; in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.operators.ordered import last_known
from forgeline.operators.ranks import values_at
from forgeline.sources.scratch import written

# The measures of the five data sets, and the quantities that can't be negative (all, and those of the basic profile).
MEASURES = [
    "Target_Qty",
    "Actual_Qty",
    "Good_Qty",
    "Reject_Qty",
    "Cycle_Time_sec",
    "Defect_Count",
    "Inspected_Qty",
    "Stock_Qty",
    "Incoming_Qty",
    "Outgoing_Qty",
    "Reorder_Point",
    "Max_Capacity",
    "Unit_Price",
    "Speed_RPM",
    "Temperature_C",
    "Vibration_mm",
    "Power_Usage_pct",
    "Downtime_min",
    "Hours_Worked",
    "Units_Produced",
    "Defects_Caused",
    "Overtime_hrs",
]
QUANTITIES = ["Target_Qty", "Actual_Qty", "Good_Qty", "Reject_Qty", "Stock_Qty", "Defect_Count", "Inspected_Qty", "Units_Produced"]
BASIC_QUANTITIES = ["Target_Qty", "Actual_Qty", "Good_Qty", "Reject_Qty", "Stock_Qty"]


def coerce(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Measures as doubles; what isn't a number becomes null, and so does NaN, which would sort into the median."""
    return df.withColumns({c: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in measures if c in df.columns})


def dedup_exact(df: DataFrame) -> DataFrame:
    """Equal rows once. It comes before filling, trimming and clipping: rows that only those make equal stay."""
    return df.dropDuplicates()


#: Hashes that occur more than once and are sent to all tasks, at most.
MOST_HASHES = 1_000_000


def dedup_few(df: DataFrame, most: int = MOST_HASHES) -> DataFrame:
    """As `dedup_exact`, for rows of which few are equal to others: only those whose hash occurs more than once are shuffled.

    Equal rows have equal hashes, and among rows of one hash all columns are compared. df is written once, to the checkpoint folder. Where more than `most`
    hashes occur more than once, all rows are shuffled, as by `dedup_exact`, and written again.
    """
    rows = written(df, "rows")
    # only columns whose equal values surely have one hash: not texts with a collation of their own, nor nested ones
    flat = [f.name for f in rows.schema if f.dataType in (T.StringType(), T.DateType(), T.TimestampType(), T.BooleanType()) or isinstance(f.dataType, T.NumericType)]
    hashed = rows.withColumn("__hash", F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in flat]))
    more = written(hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash"), "hashes")
    if more.count() > most:
        return written(dedup_exact(rows), "once")
    shared = written(dedup_exact(hashed.join(F.broadcast(more), "__hash", "left_semi").drop("__hash")), "shared")
    return hashed.join(F.broadcast(more), "__hash", "left_anti").drop("__hash").unionByName(shared)


def _kinds(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    kind = {f.name: f.dataType.typeName() for f in df.schema}
    numbers = [c for c, k in kind.items() if k in ("double", "float", "integer", "long", "short", "byte") or k.startswith("decimal")]
    return numbers, [c for c, k in kind.items() if k == "string"], [c for c, k in kind.items() if k in ("date", "timestamp", "timestamp_ntz")]


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column as __median_<column>; nulls and NaN don't count, null without any number.

    The two middle values are found by radix selection (`ranks`), which sorts nothing.
    """
    found = values_at(df, [], columns, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)})
    return found.agg(*[F.max(F.when(F.col("at") == i, (F.col("low") + F.col("high")) / 2)).alias(f"__median_{c}") for i, c in enumerate(columns)])


def fill_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null and NaN numbers become the column's exact median (`medians`), where it has one; NaN without one becomes null.

    A column of a whole-number type keeps its type and values if it has no nulls (a key, most often); with nulls it
    becomes a double, as a median may lie between two numbers. df is read twice; `clean` writes it first.
    """
    columns = columns if columns is not None else _kinds(df)[0]
    whole = [c for c in columns if df.schema[c].dataType.typeName() in ("integer", "long", "short", "byte")]
    if whole:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in whole]).first()
        columns = [c for c in columns if c not in whole or nulls[c]]
    if not columns:
        return df
    found = medians(df, columns).first()
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), F.lit(found[f"__median_{c}"]).cast("double")) for c in columns})


def fill_unknown(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns if columns is not None else _kinds(df)[1]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(f"Unknown_{c}")) for c in columns})


def fill_forward(df: DataFrame, columns: list[str], order: list[str], group: list[str] = ()) -> DataFrame:
    """Null dates take the last value before them in `order`, within `group` or, without one, in all rows; in pieces (`ordered`)."""
    return last_known(df, list(group), order, columns)


def parse_dates(df: DataFrame) -> DataFrame:
    """Every text column with "date" in its name as a date; what doesn't parse becomes null."""
    return df.withColumns({c: F.to_date(F.col(c).try_cast("timestamp")) for c in _kinds(df)[1] if "date" in c.lower()})


def standardize_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in _kinds(df)[1]})


def not_negative(c: str) -> Column:
    return F.when(F.col(c) < 0, 0).otherwise(F.col(c))


def clip_negative(df: DataFrame, columns: list[str] = QUANTITIES) -> DataFrame:
    return df.withColumns({c: not_negative(c) for c in columns if c in df.columns})


def clean(df: DataFrame, profile: str = "full", order: list[str] | None = None, few_copies: bool = False) -> DataFrame:
    """The whole chain. The basic profile neither coerces nor trims and clips fewer columns; no rows stay no rows.

    Dates that are null in columns of a date type take the last one before them in `order`, if an order is given. The rows
    without duplicates are written once, to the checkpoint folder; all later steps read them there. With `few_copies` they are found by
    `dedup_few`, which shuffles less where few rows are equal; the result is the same.
    """
    once = dedup_few if few_copies else lambda rows: written(dedup_exact(rows), "once")
    if profile == "basic":
        return clip_negative(parse_dates(fill_unknown(fill_median(once(df)))), BASIC_QUANTITIES)
    out = fill_median(once(coerce(df)))
    if order and _kinds(df)[2]:
        out = fill_forward(out, _kinds(df)[2], order)
    return clip_negative(standardize_text(parse_dates(fill_unknown(out, [c for c in _kinds(df)[1] if c not in MEASURES and "date" not in c.lower()]))))
