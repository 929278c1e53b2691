"""Values at given positions of the sorted order, found without sorting: radix selection over the bits of doubles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.sources.scratch import cut

#: Bits that one round tells apart, of 64.
BITS = 16
_TOP = 1 << 52


def sort_key(x: Column) -> Column:
    """A long for a double (not NaN) that rises as it does: the sign and the bits of its magnitude. Both zeros get 0; all steps are exact."""
    size = F.abs(x)
    near = F.floor(F.log2(size))
    exponent = near + F.when(size >= F.pow(F.lit(2.0), near + 1), 1).when(size < F.pow(F.lit(2.0), near), -1).otherwise(0)
    normal = (exponent + 1023) * F.lit(_TOP) + ((size / F.pow(F.lit(2.0), exponent) - 1) * float(_TOP)).cast("long")
    small = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(size == float("inf"), F.lit(2047 * _TOP)).when(size < 2.2250738585072014e-308, small).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def values_at(df: DataFrame, keys: list[str], columns: list[str], wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(*keys, at, n, and a value by each name of `wanted`): for each key and column (its place in `columns`) the values at positions of the sorted order.

    `wanted` gives a position, from 0, for the number n of values. Nulls and NaN don't count; a column without values has no row. Null keys
    are a key. Four rounds tell 16 bits each apart: each counts, by key and column, the values of every digit among those that agree in all
    earlier digits, so that no task sorts values and no row holds more than a count; the last digit leaves equal values only. df is read once: the
    distinct values and their numbers are written to the checkpoint folder.
    """
    cell = lambda i, c: F.struct(F.lit(i).alias("at"), F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias("value"))
    cells = df.select(*keys, F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).filter("value IS NOT NULL")
    # equal values once, with their number: tasks add up their own before anything is shuffled
    cells = cut(cells.groupBy(*keys, "at", "value").agg(F.count(F.lit(1)).alias("times")).withColumn("__key", sort_key(F.col("value"))))
    group = [*keys, "at"]
    digit = lambda shift: F.shiftright("__key", shift).bitwiseAND((1 << BITS) - 1) if shift < 64 - BITS else F.shiftright("__key", shift)

    def counted(rows: DataFrame, by: list[str], shift: int) -> DataFrame:
        bins = rows.groupBy(*by, digit(shift).alias("digit")).agg(F.sum("times").alias("c"), F.min("value").alias("value"))
        upto = F.sum("c").over(Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        return bins.withColumn("upto", upto)

    first = counted(cells, group, 64 - BITS).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    hit = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct("digit", (F.col("upto") - F.col("c")).alias("before"), "value")))
    ranks = {name: at(F.col("n")).cast("long") for name, at in wanted.items()}
    picked = first.groupBy(*group, "n").agg(*[hit(rank).alias(f"__{name}") for name, rank in ranks.items()])
    entry = lambda name: F.struct(F.lit(name).alias("name"), F.col(f"__{name}.digit").alias("prefix"), (ranks[name] - F.col(f"__{name}.before")).alias("rank"), F.col(f"__{name}.value").alias("value"))
    state = picked.select(*group, "n", F.inline(F.array(*[entry(name) for name in wanted])))
    for shift in range(64 - 2 * BITS, -1, -BITS):
        # without keys a row for each column and name; with them as many as there are keys
        state = cut(state) if keys else df.sparkSession.createDataFrame(state.collect(), state.schema)
        bins = state.select(*[F.col(c).alias(f"__{c}") for c in (*group, "prefix")]).distinct()
        inside = cells.withColumn("prefix", F.shiftright("__key", shift + BITS))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*group, "prefix")])
        # without keys there are no more bins than columns and names
        inside = inside.join(bins if keys else F.broadcast(bins), same, "left_semi")
        found = counted(inside, [*group, "prefix"], shift).select(*[F.col(c).alias(f"__{c}") for c in (*group, "prefix")], "digit", "c", "upto", F.col("value").alias("__value"))
        both = state.drop("value").join(found, same).filter(F.col("upto") > F.col("rank"))
        least = both.groupBy(*group, "n", "name", "prefix", "rank").agg(F.min(F.struct("digit", (F.col("upto") - F.col("c")).alias("before"), F.col("__value").alias("value"))).alias("x"))
        state = least.select(*group, "n", "name", (F.shiftleft("prefix", BITS) + F.col("x.digit")).alias("prefix"), (F.col("rank") - F.col("x.before")).alias("rank"), F.col("x.value").alias("value"))
    return state.groupBy(*group, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted])
