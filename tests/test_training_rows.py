"""What trees are trained on: features written once, equal rows by number."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from forgeline.operators import ml
from forgeline.plans.queries import QUERIES


class _Seen(Exception):
    pass


@pytest.mark.parametrize(("name", "model"), [("rf_metrics", "defect_model"), ("rf_importances", "defect_model"), ("gbt_confusion", "downtime_model")])
def test_features_are_read_from_where_they_were_written(spark, sf, monkeypatch, name, model):
    def seen(train, **kw):
        assert not [f for f in train.inputFiles() if sf in f]
        raise _Seen

    monkeypatch.setattr(ml, model, seen)
    with pytest.raises(_Seen):
        QUERIES[name](spark, sf)


def _rows(spark):
    return spark.range(3000).selectExpr("CAST(id % 5 AS DOUBLE) AS Temperature_C", "CAST(id % 7 AS DOUBLE) AS Vibration_mm", "CAST(id % 3 AS DOUBLE) AS Power_Usage_pct", "0e0 AS Speed_RPM", "CAST(id % 2 AS INT) AS Day_Of_Week", "concat('M-', id % 4) AS Machine_ID", "'Line_1' AS Line", "CAST(id % 5 * 3 + id % 7 > 9 AND id % 11 > 0 AS INT) AS label")


def test_boosting_on_counted_rows_equals_boosting_on_all(spark, monkeypatch):
    rows, seen, whole = _rows(spark), [], ml._model
    monkeypatch.setattr(ml, "_model", lambda train, *rest: (seen.append(train), whole(train, *rest))[1])
    counted = ml.downtime_model(rows, rounds=4, depth=3)
    n, weight = seen[0].agg(F.count(F.lit(1)), F.sum("weight")).first()
    assert n == rows.distinct().count() < 1000 and weight == 3000
    plain = whole(rows, ["Machine_ID", "Line"], ml.DOWNTIME_FEATURES, GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.1, seed=42))
    of = lambda m: [(r.prediction, round(r.probability[1], 9)) for r in m.transform(rows.distinct().orderBy(*rows.columns)).collect()]
    assert of(counted) == of(plain)
