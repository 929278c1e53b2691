"""Telemetry messages: parsing, checks, duplicates, routing; for batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

# Fixed values of the message envelope.
SUPPORTED_VERSIONS = (1,)
MOST_BYTES, MOST_ID_CHARS = 256 * 1024, 128
RUN_ID = r"^run-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
STAGES = ("INGEST", "VALIDATE", "TRANSFORM", "SILVER", "GOLD", "MART", "QUALITY", "REPORT_ELIGIBILITY")
_IDS = ("message_id", "source_id", "run_id", "correlation_id", "stage")


def parsed(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies as message_id, has_* flags of the mandatory keys, Speed_RPM as a number, and whether it is one or absent.

    Values keep their JSON types: a speed in quotes is no number. Without id and message_id, the id is the first 16 hex
    digits of the SHA-256 of the message as JSON without white space, its keys in order (of the body, if it isn't JSON).
    """
    out = df.withColumn("__v", F.try_parse_json(body))
    get = lambda k, kind: F.try_variant_get("__v", f"$.{k}", kind)
    mine = lambda k: F.nullif(get(k, "string"), F.lit(""))
    message_id = F.coalesce(mine("id"), mine("message_id"), F.substring(F.sha2(F.coalesce(F.to_json("__v"), F.col(body)), 256), 1, 16))
    kind = F.schema_of_variant(get("Speed_RPM", "variant"))
    number = F.coalesce(kind.rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.lit(True))
    return out.select("*", message_id.alias("message_id"), *[get(k, "variant").isNotNull().alias(f"has_{k}") for k in ("Machine_ID", "Date", "Line")], F.when(number, get("Speed_RPM", "double")).alias("speed"), number.alias("speed_is_number")).drop("__v")


def checked(df: DataFrame) -> DataFrame:
    """Parsed messages with status (accepted, quarantined) and reason."""
    missing = F.array_compact(F.array(*[F.when(~F.col(f"has_{k}"), k) for k in ("Machine_ID", "Date", "Line")]))
    bad_speed = ~F.col("speed_is_number") | F.coalesce(F.col("speed") < 0, F.lit(False))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(bad_speed, "negative or non-numeric speed")
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("quarantined"))


def with_duplicates(df: DataFrame, order: list[str], processed: DataFrame | None = None) -> DataFrame:
    """A batch's messages with duplicate_skipped for all but the first of an id, and for ids in `processed` (message_id)."""
    first = F.row_number().over(Window.partitionBy("message_id").orderBy(*order))
    out = df.withColumn("__n", first)
    if processed is not None:
        out = out.join(processed.select("message_id", F.lit(True).alias("__seen")).distinct(), "message_id", "left")
    seen = F.coalesce(F.col("__seen"), F.lit(False)) if processed is not None else F.lit(False)
    repeated = (F.col("__n") > 1) | seen
    return out.withColumn("reason", F.when(repeated, "already processed").otherwise(F.col("reason"))).withColumn("status", F.when(repeated, "duplicate_skipped").otherwise(F.col("status"))).drop("__n", "__seen")


def manifest(df: DataFrame, run_id: str, at: str | None = None) -> DataFrame:
    """One row of a batch: counts by status, first and last time of the column `at` if one is named, and a checksum that doesn't depend on the order.

    The checksum is the number of messages and the sum of 128 bits of each one's SHA-256 over id and status, so that repeated messages
    count as often as they came.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    times = [F.min(at).alias("started_at"), F.max(at).alias("completed_at")] if at else []
    digest = F.sha2(F.concat_ws("\x1f", "message_id", "status"), 256)
    halves = [F.coalesce(F.sum(F.conv(F.substring(digest, i, 16), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in (1, 17)]
    return df.agg(F.lit(run_id).alias("run_id"), n("accepted"), n("quarantined"), n("duplicate_skipped"), *times, F.concat_ws("-", F.count(F.lit(1)).cast("string"), *halves).alias("checksum"))


def record_manifest(made: DataFrame, folder: str, conflicts: str) -> str:
    """Writes a manifest (one row) into a folder of its own, once: recorded, or retry if an equal one is there already.

    A manifest of other messages in that place is a conflict: it stays as it is, and the new one is written to `conflicts`, with the checksum
    that it met, under its own checksum, so that a second attempt leaves the same rows.
    """
    spark, new = made.sparkSession, made.first()
    try:
        prior = spark.read.parquet(folder).first()
    except AnalysisException:
        prior = None
    if prior is None:
        spark.createDataFrame([new], made.schema).coalesce(1).write.mode("overwrite").parquet(folder)
        return "recorded"
    if (prior["run_id"], prior["checksum"]) == (new["run_id"], new["checksum"]):
        return "retry"
    met = spark.createDataFrame([new], made.schema).withColumn("met_run_id", F.lit(prior["run_id"])).withColumn("met_checksum", F.lit(prior["checksum"]))
    met.coalesce(1).write.mode("overwrite").parquet(f"{conflicts}/attempt={new['run_id']}-{new['checksum']}")
    return "conflict"


def distinct_stream(df: DataFrame, event_time: str, delay: str) -> DataFrame:
    """A stream with each message_id once within the watermark, so that the state stays bounded."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["message_id"])


def marked_repeats(stream: DataFrame, order: list[str], retention_s: float) -> DataFrame:
    """A stream's messages with `repeated`: false for the first of an id, true for all that come within `retention_s` seconds after the last of it.

    The state is one row an id, which goes once the id hasn't come for so long (with the next batch that has messages); no history is
    read. Of an id's messages in one batch the first in `order` counts; only that one is held, whatever their number. Messages are never
    dropped, however late their own times are: the state's time is that of processing.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("repeated", T.BooleanType(), False)])
    wait = int(retention_s * 1000)

    def mark(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, held = state.getCurrentProcessingTimeMs(), None
        known = state.exists and now < state.get[0]  # a row whose time is up may still be there when its id comes again
        for chunk in chunks:
            rows = chunk if held is None else pd.concat([held, chunk])
            rows = rows.sort_values(order, kind="stable")
            held, rest = rows.iloc[:1], rows.iloc[1:]
            if len(rest):
                yield rest.assign(repeated=True)[[*names, "repeated"]]
        if held is not None:
            yield held.assign(repeated=known)[[*names, "repeated"]]
        state.update((now + wait,))
        state.setTimeoutDuration(wait)

    return stream.groupBy("message_id").applyInPandasWithState(mark, schema, "until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def start_ingest(stream: DataFrame, out: str, checkpoint: str, run_id: str, order: list[str] | None = None, retention_s: float = 86400.0, at: str | None = None) -> StreamingQuery:
    """Writes each micro-batch's accepted, quarantined and (with `order`) repeated messages and its manifest.

    With `order` an id's first message counts; all that come within `retention_s` seconds are kept as duplicate_skipped (`marked_repeats`).
    Every batch overwrites its own folders, so that a batch run again after a failure leaves the same tables. A batch whose place has the
    manifest of other messages, of another run that used the same folder, stops the stream before anything is overwritten, and is reported in `manifest_conflicts`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            made = record_manifest(manifest(kept, f"{run_id}-{batch_id}", at), f"{out}/manifest/batch={batch_id}", f"{out}/manifest_conflicts")
            if made == "conflict":
                raise ValueError(f"batch {batch_id} of {out} belongs to another run")
            for status in ("accepted", "quarantined", *(["duplicate_skipped"] if order else [])):
                kept.filter(F.col("status") == status).write.mode("overwrite").parquet(f"{out}/{status}/batch={batch_id}")
        finally:
            kept.unpersist()

    if order:
        repeated = F.col("repeated")
        marked = marked_repeats(stream, order, retention_s)
        stream = marked.withColumn("reason", F.when(repeated, "already processed").otherwise(F.col("reason"))).withColumn("status", F.when(repeated, "duplicate_skipped").otherwise(F.col("status"))).drop("repeated")
    conf, spark = "spark.sql.streaming.noDataMicroBatches.enabled", stream.sparkSession
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")  # a query copies the settings when it starts; without new messages no state has to go
    try:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(conf, before)


def envelope_code(body: Column) -> Column:
    """The first thing wrong with an envelope, as a stable code; null for a good one. The version is judged before any other field."""
    v = F.try_parse_json(body)
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    code = F.when(~F.is_valid_utf8(body), "ENVELOPE_ENCODING_INVALID").when(F.octet_length(body) > MOST_BYTES, "ENVELOPE_TOO_LARGE").when(v.isNull(), "ENVELOPE_JSON_INVALID").when(~F.schema_of_variant(v).startswith("OBJECT"), "ENVELOPE_NOT_OBJECT")
    code = code.when(F.coalesce(kind("schema_version"), F.lit("")) != "BIGINT", "ENVELOPE_VERSION_MISSING").when(~get("schema_version", "long").isin(*SUPPORTED_VERSIONS), "ENVELOPE_VERSION_UNSUPPORTED")
    for name in _IDS:
        text = get(name, "string")
        code = code.when((F.coalesce(kind(name), F.lit("")) != "STRING") | (F.trim(F.coalesce(text, F.lit(""))) == ""), "ENVELOPE_FIELD_MISSING").when(F.length(text) > MOST_ID_CHARS, "ENVELOPE_FIELD_TOO_LONG")
    code = code.when(~get("run_id", "string").rlike(RUN_ID), "ENVELOPE_RUN_ID_MALFORMED").when(~get("stage", "string").isin(*STAGES), "ENVELOPE_STAGE_UNKNOWN")
    code = code.when(~F.coalesce(kind("payload"), F.lit("")).startswith("OBJECT"), "ENVELOPE_PAYLOAD_INVALID").when(F.octet_length(F.to_json(F.try_variant_get(v, "$.payload", "variant"))) > MOST_BYTES, "ENVELOPE_PAYLOAD_TOO_LARGE")
    at = get("occurred_at", "string")
    code = code.when(F.try_to_timestamp(at).isNull(), "ENVELOPE_TIMESTAMP_INVALID").when(~at.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), "ENVELOPE_TIMESTAMP_NAIVE")
    return code


def safe_summary(df: DataFrame, body: str = "body") -> DataFrame:
    """The identity of each message and the size of its payload, never the payload."""
    v = F.try_parse_json(body)
    return df.select(*[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in _IDS], F.coalesce(F.octet_length(F.to_json(F.try_variant_get(v, "$.payload", "variant"))), F.lit(0)).alias("payload_bytes"))


def _panes(log: DataFrame, every: str, delay: str | None):
    """The log by project and pane, the stretch of time by which windows move on; each row is in one."""
    return (log.withWatermark("ts", delay) if delay else log).groupBy(F.window("ts", every), "project")


def _windows(panes: DataFrame, span: str, every: str):
    """Panes by project and window: not rows but panes are repeated for the windows they lie in. `every` must divide `span`."""
    return panes.groupBy(F.window(F.window_time("window"), span, every), "project")


def error_ratio(log: DataFrame, span: str = "5 minutes", every: str = "15 seconds", most: float = 0.05, delay: str | None = None) -> DataFrame:
    """By project and sliding window the share of 5xx answers, and whether it is above `most`. With `delay`, for streams."""
    panes = _panes(log, every, delay).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("bad"))
    out = _windows(panes, span, every).agg(F.sum("n").alias("requests"), F.sum("bad").alias("failed"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "project", "requests", F.round(F.col("failed") / F.col("requests"), 4).alias("ratio"), (F.col("failed") / F.col("requests") > most).alias("alert"))


def slow_windows(log: DataFrame, span: str = "5 minutes", every: str = "15 seconds", most_ms: float = 2000.0, delay: str | None = None, k: int = 800) -> DataFrame:
    """By project and sliding window the 95th percentile of the latency, and whether it is above `most_ms`.

    Each pane has a KLL sketch, which the windows merge. A window of up to `k` latencies gets the exact value; of more, one whose
    rank is off by about 2.3 / k**0.9 of their number (0.6 % at 800). A window without any latency has none.
    """
    panes = _panes(log, every, delay).agg(F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("sketch"), F.count("latency_ms").alias("n"))
    out = _windows(panes, span, every).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))
    p95 = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "project", p95.alias("p95_ms")).withColumn("alert", F.col("p95_ms") > most_ms)
