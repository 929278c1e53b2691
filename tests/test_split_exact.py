"""The split's limit is exact where an approximate quantile isn't, and keeps rows of equal hashes together."""

import math

from pyspark.sql import functions as F

from forgeline.operators import ml


def test_split_takes_the_exact_share(spark):
    rows = spark.range(3_000_000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    train, test = ml.split(rows, ["id"])
    assert {r.label: r["count"] for r in train.groupBy("label").count().collect()} == {0: 1_600_000, 1: 800_000}
    assert test.count() == 600_000


def test_split_keeps_equal_keys_together(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.lit(1).alias("label"))
    train, test = ml.split(rows, ["k"])
    assert not {r.k for r in train.collect()} & {r.k for r in test.collect()}
    assert train.count() >= math.ceil(0.8 * 100)
