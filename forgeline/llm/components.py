"""Connected components of an edge table by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of `edges` (a, b: long): label is the smallest node of its component.

    Each round takes the least label among neighbours, then the label of the label, so that the rounds
    grow with the logarithm of the longest path in most graphs. Each round's table is written to the
    shared folder; only a count of changes comes to the driver. Self loops and repeated edges do
    no harm; rows with a null end are left out; no edges give no rows.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        ends = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = step.join(ends, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        jumped = written(jumped, "labels")
        changed = jumped.filter("label != old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
