"""Running values in pieces, medians, splits and lineage walks against plain versions."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from forgeline.operators import alerts, clean, lineage, ml, ordered, ranks
from forgeline.operators.clean import medians


def rows(n: int, seed: int = 1):
    r = random.Random(seed)
    # one key holds half of the rows, some keys and values are null
    return [(r.choice(["hot", "hot", "a", None]), i, r.choice([None, r.randrange(-5, 50)])) for i in range(n)]


@pytest.mark.parametrize("pieces", [2, 13])
@pytest.mark.parametrize("kind", ["long", "double", "string", "date", "timestamp", "timestamp_ntz"])
def test_running_sum_and_last_known(spark, kind, pieces):
    at = {"string": "lpad(cast(i AS string), 5, '0')", "date": "date_add(DATE'2024-01-01', cast(i AS int))"}.get(kind)
    at = at or ("cast(i AS %s)" % kind if kind in ("long", "double") else f"cast(timestamp_seconds(i * 3600) AS {kind})")
    df = spark.createDataFrame(rows(500), "k string, i long, v int").withColumn("at", F.expr(at)).repartition(5)
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "i", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("s"), F.sum("v").over(Window.partitionBy("k")).alias("n"))
    got = ordered.running_sum(df, ["k"], ["at"], "v", "s", "n", pieces).select("k", "i", "s", "n")
    key = lambda r: r.i
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    want = df.select("k", "i", F.last("v", ignorenulls=True).over(w).alias("v"))
    got = ordered.last_known(df, ["k"], ["at"], ["v"], pieces).select("k", "i", "v")
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


@pytest.mark.parametrize("first", ["id * id", "7", "concat('the same long prefix of every name ', lpad(id, 6, '0'))", "timestamp'2024-01-01'"])
def test_pieces_follow_the_whole_order_and_are_alike_in_size(spark, first):
    df = ordered.in_pieces(spark.range(0, 20_000, 1, 6).withColumn("x", F.expr(first)).withColumn("y", F.expr("id % 5")), ["x", "y"], 16)
    parts = df.groupBy("__piece").agg(F.min(F.struct("x", "y", "__tie")).alias("a"), F.max(F.struct("x", "y", "__tie")).alias("b"), F.count(F.lit(1)).alias("n")).orderBy("__piece").collect()
    assert len(parts) == 16 and max(p.n for p in parts) < 1.5 * 20_000 / 16
    assert all(p.b < q.a for p, q in zip(parts, parts[1:], strict=False))


def test_running_sum_of_one_timestamp(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), F.expr("timestamp'2024-01-01'").alias("at"), "id", F.lit(1).alias("v"))
    got = ordered.running_sum(df, ["k"], ["at"], "v", "s", "n", 7)
    assert sorted(r.s for r in got.collect()) == list(range(1, 2001)) and got.filter("n != 2000").isEmpty()
    assert {r.s for r in got.filter("id = 0").collect()} == {1}


def test_no_rows_and_no_keys(spark):
    df = spark.createDataFrame(rows(60), "k string, i long, v int")
    assert ordered.running_sum(df.filter("false"), ["k"], ["i"], "v", "s").count() == 0
    assert ordered.last_known(df.filter("false"), ["k"], ["i"], ["v"]).count() == 0
    assert ordered.running_sum(df, [], ["i"], "v", "s").agg(F.max_by("s", "i")).first()[0] == sum(r[2] or 0 for r in rows(60))
    assert ordered.running_sum(df.withColumn("i", F.lit(None).cast("long")), ["k"], ["i"], "v", "s").count() == 60


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_medians_are_exact(spark, n):
    r = random.Random(n)
    values = [(r.gauss(0, 1e6), r.randrange(3), float("inf") if i % 3 == 0 else float(i), None) for i in range(n)]
    df = spark.createDataFrame(values, "a double, b int, c double, d double").repartition(7)
    odd = spark.createDataFrame([(None, None, None, None), (float("nan"), None, None, float("nan"))], df.schema)
    got = medians(df.union(odd), ["a", "b", "c", "d"]).first()
    assert list(got) == [statistics.median(x[j] for x in values) for j in range(3)] + [None]


def test_medians_of_sorted_partitions(spark):
    df = spark.range(0, 9999, 1, 16).select(F.col("id").cast("double").alias("x"))
    assert medians(df, ["x"]).first()[0] == 4999.0


def test_sort_keys_rise_as_doubles_do(spark):
    import struct

    r = random.Random(3)
    values = [struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    values += [s * 2.0**e * f for e in range(-1070, 1024, 7) for f in (1.0, 1 + 2**-52, 1 - 2**-53) for s in (1, -1)]
    values = [v for v in values if v == v]
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", ranks.sort_key(F.col("x")).alias("k"))
    assert all(row.k == bits(row.x) for row in df.collect())


def test_medians_among_many_close_values(spark):
    n = 300_000
    df = spark.range(0, n, 1, 8).select((1e9 + F.col("id") * 2.0**-20).alias("close"), F.when(F.col("id") % 3 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("zero"), F.when(F.col("id") < n // 2 + 1, float("nan")).otherwise(F.col("id") % 2).alias("ties"), F.lit(None).cast("double").alias("none"))
    got = medians(df, ["close", "zero", "ties", "none"]).first()
    assert list(got) == [1e9 + (n - 1) / 2 * 2.0**-20, 0.0, statistics.median(i % 2 for i in range(n // 2 + 1, n)), None]
    plan = medians(df, ["close"])._jdf.queryExecution().executedPlan().toString()
    assert "value ASC" not in plan.split("Scan")[0]


def test_positions_by_key(spark):
    df = spark.createDataFrame(rows(900), "k string, i long, v int")
    got = {r.k: r for r in ranks.values_at(df, ["k"], ["v"], {"first": lambda n: F.lit(0), "q": lambda n: F.floor(n * 0.9), "last": lambda n: n - 1}).collect()}
    for k in {r[0] for r in rows(900)}:
        values = sorted(r[2] for r in rows(900) if r[0] == k and r[2] is not None)
        assert (got[k].n, got[k].first, got[k].q, got[k].last) == (len(values), values[0], values[int(len(values) * 0.9)], values[-1])


def test_whole_keys_stay_as_they_are(spark):
    df = spark.createDataFrame([(9007199254740993, 1, 2.0), (9007199254740992, None, None), (5, 4, 4.0)], "key long, n int, x double")
    out = clean.clean(df)
    assert out.schema["key"].dataType.typeName() == "long" and {r.key for r in out.collect()} == {9007199254740993, 9007199254740992, 5}
    assert {(r.n, r.x) for r in out.filter("key = 9007199254740992").collect()} == {(2.5, 3.0)}


def test_split_keeps_shares_of_labels(spark):
    df = spark.range(3000).withColumn("label", (F.col("id") % 100 == 0).cast("int"))
    train, test = ml.split(df, ["id"])
    assert {r.label: r["count"] for r in train.groupBy("label").count().collect()} == {0: 2376, 1: 24}
    assert test.count() == 600 and train.join(test, "id").count() == 0


def test_walks_and_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "source_dataset string, target_dataset string")
    found = lambda df: sorted(r.dataset for r in df.collect())
    assert found(lineage.descendants(edges, "a")) == ["b", "c"] and found(lineage.ancestors(edges, "c")) == ["a", "b"]
    assert found(lineage.descendants(edges, "x")) == ["x", "y", "z"] and found(lineage.ancestors(edges, "nowhere")) == []


def test_alerts_carry_their_time(spark):
    daily = spark.createDataFrame([("2024-01-01", 9.0, 70.0)], "Date string, Reject_Rate_pct double, Achievement_Rate_pct double")
    stock = spark.createDataFrame([("2024-01-01", "p", 50, 60)], "Date string, Product string, Stock_Qty int, Reorder_Point int")
    machine = spark.createDataFrame([("2024-01-01", "m", "Failure", 90, None, None)], "Date string, Machine_ID string, Status string, Downtime_min int, Temperature_C double, Vibration_mm double")
    oee = spark.createDataFrame([("2024-01-01", 50.0)], "Date string, OEE_pct double")
    out = alerts.check_all(daily, stock, machine, oee)
    assert out.count() == 7 and out.filter("timestamp IS NULL").count() == 0
    assert [r.level for r in alerts.prioritised(out).collect()] == ["CRITICAL"] * 4 + ["WARNING"] * 3
    assert clean.fill_median(daily.filter("false")).count() == 0
