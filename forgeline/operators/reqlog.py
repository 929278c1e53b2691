"""Usage analytics of a model-request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.operators.ordered import running_sum
from forgeline.operators.ranks import values_at

# Histogram bounds in seconds, and the price of a million tokens in dollars.
BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]
USD_A_MILLION = 10.0
GENERIC_MODELS = ("fast", "reasoning", "general", "default", "auto")


def positional(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """By key the values at floor(n * fraction) of the sorted order, from 0: positions, no interpolation; by radix selection (`ranks`)."""
    found = values_at(df, keys, [value], {name: lambda n, q=q: F.floor(n * q) for name, q in fractions.items()})
    return found.select(*keys, *fractions)


def is_error() -> Column:
    return F.col("status") >= 400


def project_stats(log: DataFrame) -> DataFrame:
    positive = lambda c: F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)))
    base = log.groupBy("project").agg(F.count(F.lit(1)).alias("requests"), F.count_if(is_error()).alias("errors"), (positive("prompt_chars") + positive("completion_chars")).alias("chars"), F.count_distinct("model").alias("models"))
    out = base.select("project", "requests", "errors", F.round(F.col("errors") / F.col("requests"), 3).alias("error_rate"), F.floor(F.col("chars") / 4).cast("long").alias("est_tokens"), "models")
    out = out.withColumn("usd_saved", F.round(F.col("est_tokens") / 1e6 * USD_A_MILLION, 4))
    return out.join(positional(log, ["project"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "project", "left")


def endpoint_latency(log: DataFrame) -> DataFrame:
    means = log.groupBy("endpoint").agg(F.round(F.avg("latency_ms"), 4).alias("mean_ms"))
    return means.join(positional(log, ["endpoint"], "latency_ms", {"p95_ms": 0.95}), "endpoint", "left")


def tokens_by_model(log: DataFrame) -> DataFrame:
    return log.groupBy("model").agg(F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"))


def failures_by_project(log: DataFrame) -> DataFrame:
    return log.filter(is_error()).groupBy("project").agg(F.count(F.lit(1)).alias("failures"))


def requests_by_project(log: DataFrame) -> DataFrame:
    return log.groupBy("project").agg(F.count(F.lit(1)).alias("requests"))


def slowest(log: DataFrame, n: int = 10) -> DataFrame:
    return log.select("id", "project", "latency_ms").orderBy(F.desc_nulls_last("latency_ms"), "id").limit(n)


def latency_histogram(log: DataFrame, bounds: list[float] = BUCKETS) -> DataFrame:
    """Cumulative counts up to each bound and in all, with sum and count, by project; accumulated once."""
    seconds = F.col("latency_ms") / 1000
    names = [f"le_{b:g}".replace(".", "_") for b in bounds]
    return log.groupBy("project").agg(*[F.count_if(seconds <= b).alias(n) for b, n in zip(bounds, names, strict=True)], F.count("latency_ms").alias("le_inf"), F.round(F.sum(seconds), 4).alias("sum_s"), F.count("latency_ms").alias("count"))


def estimated_tokens(prompt: Column, completion: Column) -> Column:
    return (F.greatest(F.lit(1), F.floor(prompt / 4)) + F.greatest(F.lit(0), F.floor(completion / 4))).cast("long")


def quota_usage(log: DataFrame, quota: int) -> DataFrame:
    """Tokens used so far by project and UTC day, before and with each request, and whether it is over the quota; in pieces (`ordered`)."""
    used = log.select("event_id", "project", F.to_date("ts").alias("day"), "ts", estimated_tokens(F.col("prompt_chars"), F.col("completion_chars")).alias("tokens"))
    return running_sum(used, ["project", "day"], ["ts", "event_id"], "tokens", "used").select("event_id", "project", "day", "tokens", "used", (F.col("used") > quota).alias("over_quota"))


def prompt_fingerprint(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", F.length(text).cast("long").alias("prompt_chars"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16).alias("prompt_sha"))


def routed(requests: DataFrame, aliases: DataFrame, default_model: str, vision_model: str) -> DataFrame:
    """Requests (model, task, has_image) with the model that serves them: task, then image default, then alias, then the model named.

    Aliases (alias, target) are a short configured table.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    by_task, by_model = aliases.select(F.col("alias").alias("__t"), F.col("target").alias("task_target")), aliases.select(F.col("alias").alias("__m"), F.col("target").alias("alias_target"))
    joined = requests.join(F.broadcast(by_task), key("task") == F.col("__t"), "left").join(F.broadcast(by_model), key("model") == F.col("__m"), "left")
    generic = key("model").isin("", *GENERIC_MODELS)
    named = F.when(~key("model").isin("", "auto"), F.trim("model"))
    chosen = F.coalesce("task_target", F.when(F.col("has_image") & generic, F.lit(vision_model)), "alias_target", named, F.lit(default_model))
    return joined.select(*requests.columns, chosen.alias("resolved"))
