"""Lineage edges and the catalog as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.operators import graph

ZONES = ("RAW", "SILVER", "GOLD", "MART")
_GOLD = ("gold_oee_daily", "gold_quality_daily", "gold_inventory_snapshot", "gold_machine_health")
#: The catalog of this library's own tables: name, zone, owner, source, consumers, freshness in hours.
CATALOG = [
    ("raw_production", "RAW", "manufacturing-data", [], [], 24),
    ("silver_production", "SILVER", "manufacturing-data", ["raw_production"], list(_GOLD), 24),
    *[(g, "GOLD", "manufacturing-data", ["silver_production"], [], 48) for g in _GOLD],
    *[(m, "MART", "manufacturing-data", [g], [], 48) for m, g in (("mart_oee", _GOLD[0]), ("mart_quality", _GOLD[1]), ("mart_inventory", _GOLD[2]))],
]
CATALOG_SCHEMA = "name string, zone string, owner string, source array<string>, consumers array<string>, freshness_sla_hours int"


def default_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def clean_edges(edges: DataFrame) -> DataFrame:
    """(source_dataset, target_dataset, transform) once each, without loops from a table to itself."""
    return edges.filter("source_dataset != target_dataset").dropDuplicates(["source_dataset", "target_dataset", "transform"])


def catalog_edges(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("source").alias("source_dataset"), F.col("name").alias("target_dataset"), F.lit("catalog").alias("transform"))


def upstream(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("target_dataset") == name).select(F.col("source_dataset").alias("dataset")).distinct()


def downstream(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("source_dataset") == name).select(F.col("target_dataset").alias("dataset")).distinct()


def _graph(edges: DataFrame, start: str = "source_dataset", end: str = "target_dataset") -> DataFrame:
    return edges.select(F.col(start).alias("a"), F.col(end).alias("b"))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant) of all paths, whatever their length; a table is its own ancestor only on a cycle."""
    return graph.closure(_graph(edges)).select(F.col("a").alias("ancestor"), F.col("b").alias("descendant"))


def ancestors(edges: DataFrame, name: str) -> DataFrame:
    """What `name` is made from, directly or not; `name` itself only on a cycle."""
    return graph.reachable(_graph(edges, "target_dataset", "source_dataset"), name).select(F.col("node").alias("dataset"))


def descendants(edges: DataFrame, name: str) -> DataFrame:
    """What is made from `name`, directly or not; `name` itself only on a cycle."""
    return graph.reachable(_graph(edges), name).select(F.col("node").alias("dataset"))


def cycles(edges: DataFrame) -> DataFrame:
    """(dataset, cycle): tables that lie on a cycle; those on a common one, which each can be made from, have the same `cycle`."""
    return graph.components_on_cycles(_graph(edges)).select(F.col("node").alias("dataset"), F.col("component").alias("cycle"))


def catalog_problems(catalog: DataFrame) -> DataFrame:
    """(name, problem): missing fields, unknown zones, sources and consumers that no entry has."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    missing = catalog.select("name", F.explode(F.array_compact(F.array(F.when(blank("owner"), "missing owner"), F.when(blank("zone"), "missing zone"), F.when(~blank("zone") & ~F.col("zone").isin(*ZONES), F.concat(F.lit("bad zone "), "zone"))))).alias("problem"))
    names = catalog.select(F.col("name").alias("ref")).distinct()
    dangling = None
    for column in ("source", "consumers"):
        part = catalog.select("name", F.explode(column).alias("ref")).join(names, "ref", "left_anti").select("name", F.concat(F.lit(f"dangling {column} "), "ref").alias("problem"))
        dangling = part if dangling is None else dangling.unionByName(part)
    return missing.unionByName(dangling)


def listing(catalog: DataFrame) -> DataFrame:
    """By zone from raw to mart, then by name."""
    order = F.array_position(F.array(*[F.lit(z) for z in ZONES]), F.col("zone"))
    return catalog.select("name", "zone").orderBy(F.when(order > 0, order).otherwise(99), "name")
