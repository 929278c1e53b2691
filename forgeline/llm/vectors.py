"""What both searches over vectors share: valid vectors, representatives of equal ones, and the answer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.llm.common import quoted


def valid(vector: Column) -> Column:
    """Neither null, empty nor zero, and no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def rows_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec: array<double>) of the rows that take part; rows with a null id don't."""
    vec = F.transform(quoted(vec_col), lambda x: x.cast("double"))
    return df.filter(quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("id"), vec.alias("vec")).filter(valid(F.col("vec")))


def representatives(rows: DataFrame, key: str, k: int) -> DataFrame:
    """One row for each value of `key`, with its k + 1 smallest ids in order.

    The limit by row number is taken before the shuffle too, so that a value of a third of
    all rows sends k + 1 rows a task. Of a key, k + 1 ids are enough for any query's k nearest but itself.
    """
    first = Window.partitionBy(key).orderBy("id")
    few = rows.select(key, "id").distinct() if key != "vec" else rows.select("vec", "id")
    few = few.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    return few.groupBy(key).agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids"))


def blocks(n: int, most: int, least: int, tasks: int) -> int:
    """Into how many blocks n rows go: of `most` rows at most, and while they keep `least` rows as many as tasks."""
    return max(1, -(-n // most), min(-(-n // least), tasks))


def answers(queries: DataFrame, found: DataFrame, key: str, k: int, measure: str, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, measure): of each query's key the k best ids but its own, equal ones by id.

    `found` has rows (key, measure, id), the best k + 1 at least of every block.
    """
    best = Window.partitionBy(key).orderBy(F.col(measure).desc() if descending else F.col(measure).asc(), "id")
    merged = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "id", measure))).alias("list"))
    per_query = queries.join(lists, key).select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("pos", "hit"))
    return per_query.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col(f"hit.{measure}").alias(measure))
