"""Feature tables and models for defects and downtime."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeline.sources.scratch import cut, written

DEFECT_FEATURES = ["Target_Qty", "Actual_Qty", "Cycle_Time_sec", "Machines", "Reject_Rate", "Achievement", "Defects", "Inspected", "Critical_Count"]
DOWNTIME_FEATURES = ["Temperature_C", "Vibration_mm", "Power_Usage_pct", "Speed_RPM", "Day_Of_Week"]
#: Rows of a task that trains trees.
TASK_ROWS = 250_000


def defect_features(production: DataFrame, quality: DataFrame) -> DataFrame:
    """By date, line and shift: sums, ratios, the line's defects of the day (0 without any), label 1 from a reject rate over 5 %."""
    made = production.groupBy("Date", "Line", "Shift").agg(F.sum("Target_Qty").alias("Target_Qty"), F.sum("Actual_Qty").alias("Actual_Qty"), F.sum("Good_Qty").alias("Good_Qty"), F.sum("Reject_Qty").alias("Reject_Qty"), F.avg("Cycle_Time_sec").alias("Cycle_Time_sec"), F.count_distinct("Machine_ID").alias("Machines"))
    found = quality.groupBy("Date", "Line").agg(F.sum("Defect_Count").alias("Defects"), F.sum("Inspected_Qty").alias("Inspected"), F.count_if(F.col("Severity") == "Critical").alias("Critical_Count"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    out = made.join(found, ["Date", "Line"], "left").na.fill(0, ["Defects", "Inspected", "Critical_Count"])
    out = out.select("*", ratio("Actual_Qty", "Target_Qty").alias("Achievement"), ratio("Reject_Qty", "Actual_Qty").alias("Reject_Rate"), ratio("Defects", "Inspected").alias("Defect_Ratio"))
    return out.withColumn("label", (F.col("Reject_Rate") > 0.05).cast("int"))


def downtime_features(machine: DataFrame) -> DataFrame:
    return machine.select("Reading", "Date", "Machine_ID", "Line", "Temperature_C", "Vibration_mm", "Power_Usage_pct", "Speed_RPM", F.weekday("Date").alias("Day_Of_Week"), (F.col("Status") == "Failure").cast("int").alias("is_failure"), (F.col("Downtime_min") > 0).cast("int").alias("label"))


def split(df: DataFrame, key: list[str], share: float = 0.8, seed: int = 42, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Train and test rows, the same on every run: of each label's rows the given share, by a hash of the key.

    The hash is 52 bits of the MD5 of seed and key, which other engines have too. A label's limit is the hash at place ceil(share * n)
    of its order; rows at the limit are train rows. It is found exactly: counts by the first 16 bits name the bin, whose distinct values alone are put in order.
    """
    line = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    place = F.conv(F.substring(F.md5(line), 1, 13), 16, 10).cast("long")
    placed = df.withColumn("__place", place)
    hashes = placed.select(F.col(label).alias("__label"), "__place", F.shiftright("__place", 36).alias("__bin"))
    upto = lambda *by: F.sum("__c").over(Window.partitionBy("__label").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    bins = hashes.groupBy("__label", "__bin").agg(F.count(F.lit(1)).alias("__c"))
    bins = bins.select("*", upto("__bin").alias("__upto"), F.ceil(F.lit(float(share)) * F.sum("__c").over(Window.partitionBy("__label"))).alias("__rank"))
    # one row a label
    hit = cut(bins.filter("__upto >= __rank AND __upto - __c < __rank").select(F.col("__label").alias("__of"), F.col("__bin").alias("__in"), (F.col("__rank") - F.col("__upto") + F.col("__c")).alias("__rest")))
    inside = hashes.join(F.broadcast(hit), F.col("__label").eqNullSafe(F.col("__of")) & (F.col("__bin") == F.col("__in")))
    values = inside.groupBy("__label", "__rest", "__place").agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", upto("__place"))
    limits = cut(values.filter("__upto >= __rest").groupBy("__label").agg(F.min("__place").alias("__limit")))
    placed = placed.join(F.broadcast(limits), F.col(label).eqNullSafe(F.col("__label")))
    return placed.filter("__place <= __limit").select(*df.columns), placed.filter("__place > __limit").select(*df.columns)


def _model(train: DataFrame, texts: list[str], numbers: list[str], classifier) -> PipelineModel:
    index = StringIndexer(inputCols=texts, outputCols=[f"{t}_idx" for t in texts], stringOrderType="alphabetAsc", handleInvalid="keep")
    features = VectorAssembler(inputCols=[*numbers, *[f"{t}_idx" for t in texts]], outputCol="features", handleInvalid="keep")
    # the copy is without the training summary, which holds the session: tasks could not be sent once that has observed a count
    return Pipeline(stages=[index, features, classifier]).fit(train).copy()


def defect_model(train: DataFrame, trees: int = 100, depth: int = 10, with_rate: bool = True) -> PipelineModel:
    """A random forest. The reject rate decides the label; without it (with_rate=False) the others have to tell."""
    numbers = [f for f in DEFECT_FEATURES if with_rate or f != "Reject_Rate"]
    return _model(train, ["Line", "Shift"], numbers, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42))


def _counted(train: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are equal in `columns` once, with their number `weight`; dealt evenly, so that each pass over them has all cores."""
    distinct = written(train.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("weight")), "counted")
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, distinct.count() // TASK_ROWS + 1)
    return distinct.repartition(int(tasks), *columns)


def downtime_model(train: DataFrame, rounds: int = 100, depth: int = 6, step: float = 0.1) -> PipelineModel:
    """Boosted trees. All rows count; equal ones are read once a pass, with their number as weight, which gives the sums that they would give apart."""
    texts = ["Machine_ID", "Line"]
    rows = _counted(train, [*DOWNTIME_FEATURES, *texts, "label"])
    return _model(rows, texts, DOWNTIME_FEATURES, GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=42, weightCol="weight"))


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def metrics(predicted: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall, F1 of label 1, from one aggregate."""
    n = lambda a, b: F.count_if((F.col("label") == a) & (F.col("prediction") == b))
    c = predicted.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(div(tp + tn, tp + tn + fp + fn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def importances(spark, model: PipelineModel, n: int = 5) -> DataFrame:
    names = model.stages[1].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(sorted(zip(names, values, strict=True), key=lambda x: -x[1])[:n], "feature string, importance double")
