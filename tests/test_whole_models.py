"""The model queries train the operators' own models."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from forgeline.operators import ml
from forgeline.plans import queries


@pytest.mark.parametrize(("name", "model", "size", "depth"), [("rf_metrics", "defect_model", 100, 10), ("gbt_confusion", "downtime_model", 100, 6)])
def test_queries_train_the_whole_model(spark, sf, monkeypatch, name, model, size, depth):
    made = []
    monkeypatch.setattr(ml, model, lambda *a, f=getattr(ml, model), **b: made.append(f(*a, **b)) or made[-1])
    rows = queries.QUERIES[name](spark, sf).collect()
    trees = made[0].stages[-1]
    assert trees.getNumTrees == size and trees.getMaxDepth() == depth
    assert 0.5 < rows[0].accuracy <= 1 if name == "rf_metrics" else sum(r.n for r in rows) > 0 and {r.label for r in rows} == {0, 1}


def test_a_forest_predicts_in_a_session_that_has_observed_counts(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get["rows"] == 3
    numbers = [(F.col("id") * (i + 1) % 7).cast("double").alias(f) for i, f in enumerate(ml.DEFECT_FEATURES)]
    rows = spark.range(60).select(*numbers, F.lit("L").alias("Line"), F.lit("S").alias("Shift"), (F.col("id") % 2).cast("int").alias("label"))
    model = ml.defect_model(rows, trees=3, depth=3)
    assert model.transform(rows).filter("prediction IN (0, 1)").count() == 60
    assert ml.importances(spark, model).count() == 5
