"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_num(num: Column, den: Column) -> Column:
    """num / den, where a denominator of 0 counts as 1 (the KPI rule)."""
    return num / F.when(den == 0, 1).otherwise(den)


def ratio_or_null(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is 0 (the gold rule)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_from_one(num: Column, den: Column) -> Column:
    """num / den with a denominator of 1 at least (the worker ranking's rule)."""
    return num / F.greatest(den, F.lit(1))


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    return F.round(ratio_or_num(num * F.lit(100.0), den), digits)


def finite(c: Column) -> Column:
    """c, but null instead of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_cell(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula; null becomes empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(r"^[ \t]*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def stock_status(stock: Column, reorder: Column, pct: Column) -> Column:
    return F.when(stock <= 0, "OUT_OF_STOCK").when(stock < reorder, "REORDER").when(pct > 90, "OVER_CAPACITY").otherwise("OK")


def warnings(max_temp: Column, max_vib: Column) -> Column:
    return F.when(max_temp > 75, 1).otherwise(0) + F.when(max_vib > 4.5, 1).otherwise(0)


def health_status(max_temp: Column, max_vib: Column) -> Column:
    n = warnings(max_temp, max_vib)
    return F.when(n == 0, "HEALTHY").when(n == 1, "WARN").otherwise("CRITICAL")


# What in a file name tells a data set, in the order of precedence; the strict ones are whole names.
DATASET_PATTERNS = {
    "production": ["production", "prod"],
    "quality": ["quality", "qual"],
    "inventory": ["inventory", "inv", "stock"],
    "machine": ["machine", "mach", "equipment"],
    "workers": ["workers", "worker", "employee", "staff"],
}


def dataset_of(name: Column, strict: bool = False) -> Column:
    """The data set that a file name belongs to, else null. Strict: the full name, after a date at most."""
    base = F.lower(F.element_at(F.split(name, "[/\\\\]"), -1))
    out = F.lit(None).cast("string")
    for dataset, patterns in reversed(DATASET_PATTERNS.items()):
        hit = base.rlike(rf"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}_)?{dataset}\.[a-z]+(\.gz)?$") if strict else base.rlike("|".join(patterns))
        out = F.when(hit, dataset).otherwise(out)
    return out
