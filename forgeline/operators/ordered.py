"""Running values by key, worked out in pieces of the order, so that no task holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeline.sources.scratch import cut

def in_pieces(df: DataFrame, order: list[str], pieces: int | None = None) -> DataFrame:
    """df with `__piece`, which never falls along `order`, and `__tie`, which tells apart rows that are equal in all of it.

    Spark's range partitioning cuts the whole order, its ties among them, into pieces of about equal size, as many as there are shuffle
    partitions. The rows are written with their piece to the checkpoint folder, so that it stays the same wherever they are read.
    """
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = df.withColumn("__tie", F.monotonically_increasing_id())
    return cut(told.repartitionByRange(pieces, *order, "__tie").withColumn("__piece", F.spark_partition_id()))


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows (__own 1) and before each piece of each key the row that carries what came before it (__own 0)."""
    return rows.withColumn("__own", F.lit(1)).unionByName(heads.withColumn("__own", F.lit(0)), allowMissingColumns=True)


def _inside(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, "__piece").orderBy("__own", *order, "__tie").rowsBetween(Window.unboundedPreceding, 0)


def _earlier(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, total: str | None = None, pieces: int | None = None) -> DataFrame:
    """df with the sum of `value` up to each row of its key in `order`, and over the whole key as `total`.

    The pieces cut the order of keys and then `order`, so that a key has few of them unless it is large. Sums by piece are carried over by a window
    over the pieces of a key; rows are sorted by key and piece only, and rows that tie follow each other as they were read.
    Null values count as 0; null keys are a key. Without rows there are none.
    """
    rows = in_pieces(df, [*keys, *order], pieces).withColumn("__v", F.coalesce(F.col(value), F.lit(0)))
    sums = rows.groupBy(*keys, "__piece").agg(F.sum("__v").alias("__sum"))
    heads = sums.select(*keys, "__piece", F.coalesce(F.sum("__sum").over(_earlier(keys)), F.lit(0)).alias("__v"), F.sum("__sum").over(Window.partitionBy(*keys)).alias("__all"))
    out = _with_heads(rows, heads).withColumn(name, F.sum("__v").over(_inside(keys, order)))
    if total:
        out = out.withColumn(total, F.first("__all").over(_inside(keys, order)))
    return out.filter("__own = 1").drop("__own", "__piece", "__tie", "__v", "__all")


def last_known(df: DataFrame, keys: list[str], order: list[str], columns: list[str], pieces: int | None = None) -> DataFrame:
    """df, where nulls of `columns` take the last value before them in their key. Rows that tie in `order` follow each other as they were read."""
    rows = in_pieces(df, [*keys, *order], pieces)
    lasts = rows.groupBy(*keys, "__piece").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, "__tie"))).alias(c) for c in columns])
    heads = lasts.select(*keys, "__piece", *[F.last(c, ignorenulls=True).over(_earlier(keys)).alias(c) for c in columns])
    return _with_heads(rows, heads).withColumns({c: F.last(c, ignorenulls=True).over(_inside(keys, order)) for c in columns}).filter("__own = 1").drop("__own", "__piece", "__tie")
