"""The ledger of stage runs: canonical attempts, transitions, leases, dispositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The permitted transitions, the terminal states, transient errors, and the retry budget.
ALLOWED = [("PENDING", "RUNNING"), ("RUNNING", "SUCCEEDED"), ("RUNNING", "RETRYABLE"), ("RUNNING", "FAILED"), ("RETRYABLE", "RUNNING"), ("RETRYABLE", "DEAD_LETTERED")]
TRANSIENT = ("ConnectionError", "TimeoutError", "OperationalError", "InterfaceError", "DBAPIError")
MOST_ATTEMPTS = 5


def canonical_attempts(attempts: DataFrame) -> DataFrame:
    """One row a run and stage: the first success if there is any, else the last attempt; with the number of attempts."""
    attempt = F.struct("attempt", "status")
    chosen = F.coalesce(F.min(F.when(F.col("status") == "SUCCEEDED", attempt)), F.max(attempt))
    found = attempts.groupBy("run_id", "stage").agg(chosen.alias("x"), F.count(F.lit(1)).alias("attempt_count"))
    return found.select("run_id", "stage", "x.attempt", "x.status", "attempt_count")


def illegal_transitions(history: DataFrame) -> DataFrame:
    """Steps of (run_id, stage, seq, status) that the state machine doesn't allow; the first status must be PENDING."""
    w = Window.partitionBy("run_id", "stage").orderBy("seq")
    steps = history.withColumn("from_status", F.lag("status").over(w))
    legal = F.lit(False)
    for a, b in ALLOWED:
        legal = legal | ((F.col("from_status") == a) & (F.col("status") == b))
    return steps.filter(F.when(F.col("from_status").isNull(), F.col("status") != "PENDING").otherwise(~legal)).select("run_id", "stage", "seq", "from_status", F.col("status").alias("to_status"))


def expired_leases(ledger: DataFrame, now: str) -> DataFrame:
    return ledger.filter((F.col("status") == "RUNNING") & (F.col("lease_until") <= F.lit(now).cast("timestamp")))


def failure_class(error: Column) -> Column:
    return F.when(error.isin(*TRANSIENT), "TRANSIENT").otherwise("PERMANENT")


def after_failure(outcomes: DataFrame, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """(…, error_code, attempt) with failure_class and disposition: RETRY a transient failure within the budget, else DEAD_LETTER."""
    cls = failure_class(F.col("error_code"))
    return outcomes.select("*", cls.alias("failure_class"), F.when((cls == "PERMANENT") | (F.col("attempt") >= most_attempts), "DEAD_LETTER").otherwise("RETRY").alias("disposition"))


def dispositions(deliveries: DataFrame, ledger: DataFrame, now: str) -> DataFrame:
    """Deliveries (message_id, run_id, stage, error_code of the envelope or null) against the ledger (run_id, stage, status, lease_until)."""
    live = F.col("lease_until") > F.lit(now).cast("timestamp")
    out = (
        F.when(F.col("error_code").isNotNull(), "DEAD_LETTER")
        .when(F.col("status") == "SUCCEEDED", "ACK_DUPLICATE")
        .when((F.col("status") == "RUNNING") & live, "DEFER")
        .when(F.col("status").isin("FAILED", "DEAD_LETTERED"), "DEAD_LETTER")
        .otherwise("PROCESS")
    )
    return deliveries.join(ledger, ["run_id", "stage"], "left").select("message_id", "run_id", "stage", out.alias("disposition"))


def outcome_counters(disposed: DataFrame) -> DataFrame:
    """One row of counters."""
    n = lambda d: F.count_if(F.col("disposition") == d)
    return disposed.agg(F.count(F.lit(1)).alias("received"), n("PROCESS").alias("completed"), n("ACK_DUPLICATE").alias("duplicates"), n("DEFER").alias("deferred"), n("RETRY").alias("retried"), n("DEAD_LETTER").alias("dead_lettered"))
