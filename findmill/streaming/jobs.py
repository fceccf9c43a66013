"""The streaming jobs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions.text import first_int
from findmill.sources.reports import ingest_all
from findmill.streaming.processors import EventBuffer, Lifecycle, ScanProgress, StaleScans, Triage
from findmill.streaming.runner import read_state, run_to_files, run_to_state

DAY_MS = 86_400_000


def read_report_stream(spark: SparkSession, folder: str, engine: str) -> DataFrame:
    """New report files of one engine as ``(report_id, engine, body)``; one document per file."""
    raw = spark.readStream.format("text").option("wholetext", "true").load(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return raw.select(name.alias("report_id"), F.lit(engine).alias("engine"), F.col("value").alias("body"))


def stream_report_ingest(reports: DataFrame, path: str) -> str:
    """Findings of arriving reports; no state, so every engine's rows just append."""
    return run_to_files(ingest_all(reports), path)


def stream_dedup(
    findings: DataFrame, path: str, event_time: str, lifetime: str, salts: int = 16, row_id: Column | None = None
) -> str:
    """One row per (scan, fingerprint).

    ``lifetime`` must span the time between copies of one scan; a later copy counts as new. Copies are first reduced per salt, so a
    fingerprint that fills the stream is spread over ``salts`` tasks before its remaining
    few rows meet. Which copy survives is not defined.
    """
    keys = ["scan_id", "fingerprint"]
    salt = F.pmod(F.xxhash64(*([row_id] if row_id is not None else findings.columns)), F.lit(salts))
    spread = findings.withColumn("_salt", salt).withWatermark(event_time, lifetime)
    first = spread.dropDuplicatesWithinWatermark([*keys, "_salt"])
    return run_to_files(first.dropDuplicatesWithinWatermark(keys).drop("_salt"), path)


def stream_engine_state(events: DataFrame, path: str, order: str) -> str:
    """Latest state per (scan, engine), kept in the state store; partial aggregation precedes it. Returns the checkpoint folder."""
    latest = events.groupBy("scan_id", "engine").agg(F.max(F.struct(order, "state", "kind")).alias("latest"))
    return run_to_state(latest, path)


def engine_state_view(spark: SparkSession, checkpoint: str) -> DataFrame:
    rows = read_state(spark, checkpoint)
    return rows.select("scan_id", "engine", F.col("max.state").alias("state"), F.col("max.kind").alias("kind"))


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def stream_event_buffer(events: DataFrame, path: str, order: list[str], size: int = K.EVENT_RING_SIZE) -> str:
    """Numbered events that entered the ring of their scan; ``ring_view`` reads the rings. Returns the data folder."""
    columns = [c for c in events.columns if c != "scan_id"]
    schema = _ddl(events, columns)
    out = f"{_ddl(events, ['scan_id'])}, seq long, {schema}"
    return run_to_files(events.groupBy("scan_id").transformWithState(EventBuffer(columns, schema, order, size), out, "Append", "None"), path)


def ring_view(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last events of every scan, as the state store holds them."""
    return read_state(spark, checkpoint, "ring")


def stream_progress(polls: DataFrame, path: str, order: list[str]) -> str:
    """Changes of the percentage per scan, up to the first 100; unreadable percentages count as 0."""
    rows = polls.select("scan_id", *order, F.coalesce(first_int("status"), F.lit(0)).cast("long").alias("pct"))
    out = f"{_ddl(rows, ['scan_id', *order])}, pct long"
    return run_to_files(rows.groupBy("scan_id").transformWithState(ScanProgress(order), out, "Append", "None"), path)


def stream_triage(changes: DataFrame, path: str, findings: DataFrame | None = None) -> str:
    """Audit rows of arriving status changes; unknown statuses are rejected. Returns the data folder.

    ``findings(finding_id, status, triage_reason)``, one row each, gives the statuses that a new stream starts from;
    a restart goes on from its state.
    """
    valid = changes.where(F.col("to_status").isin(*K.FINDING_STATUSES)).select("finding_id", "seq", "to_status", "reason")
    start = None if findings is None else findings.select("finding_id", "status", F.col("triage_reason").alias("reason")).groupBy("finding_id")
    out = f"{_ddl(valid, ['finding_id', 'seq'])}, from_status string, to_status string, reason string"
    return run_to_files(valid.groupBy("finding_id").transformWithState(Triage(), out, "Append", "None", initialState=start), path)


def triage_view(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Current status and reason of every finding the stream knows; ``seq`` is that of its last change, null if it never changed."""
    return read_state(spark, checkpoint, "current").select("finding_id", "status", F.col("reason").alias("triage_reason"), "seq")


def lifecycle(events: DataFrame) -> DataFrame:
    """Accepted transitions ``(scan_id, seq, status)`` of scans, with an ``__end__`` row at the end.

    A scan is pending, runs at its first ``running`` event and ends at its first ``failed`` or
    ``aborted`` event, or at the first ``succeeded`` event after it ran. Everything else, and all
    that comes after the end, is ignored. Only minima are needed, so no scan is ever sorted.
    """
    seq, status = F.col("seq"), F.col("status")
    bad = F.min(F.when(status.isin("failed", "aborted"), F.struct("seq", "status"))).alias("_bad")
    firsts = events.groupBy("scan_id").agg(F.min(F.when(status == "running", seq)).alias("_run"), bad)
    good = (
        events.where(status == "succeeded")
        .join(firsts.select("scan_id", "_run"), "scan_id")
        .where(F.col("seq") > F.col("_run"))
        .groupBy("scan_id")
        .agg(F.min(F.struct("seq", "status")).alias("_good"))
    )
    ended = firsts.join(good, "scan_id", "left").withColumn("_end", F.least("_bad", "_good"))
    began = F.col("_run").isNotNull() & (F.col("_end").isNull() | (F.col("_run") < F.col("_end.seq")))
    rows = F.array_compact(
        F.array(
            F.when(began, F.struct(F.col("_run").alias("seq"), F.lit("running").alias("status"))),
            F.col("_end"),
            F.when(F.col("_end").isNotNull(), F.struct(F.col("_end.seq").alias("seq"), F.lit("__end__").alias("status"))),
        )
    )
    return ended.select("scan_id", F.explode(rows).alias("r")).select("scan_id", "r.seq", "r.status")


def stream_scan_lifecycle(events: DataFrame, path: str, memory_ms: int = 7 * DAY_MS) -> str:
    """Transitions of arriving status events. The state holds the open scans (``open_scans``); an ended scan is remembered
    for ``memory_ms`` of processing time, so that late events do not open it again. Returns the data folder."""
    rows = events.select("scan_id", F.col("seq").cast("long").alias("seq"), "status")
    out = f"{_ddl(rows, ['scan_id'])}, seq long, status string"
    return run_to_files(rows.groupBy("scan_id").transformWithState(Lifecycle(memory_ms), out, "Append", "ProcessingTime"), path, idle_batches=False)


def open_scans(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(scan_id, status) of the scans that have not ended."""
    return read_state(spark, checkpoint, "status").select("scan_id", "status")


def stream_stale_scans(events: DataFrame, path: str, timeout_ms: int, lateness: str, memory_ms: int = 365 * DAY_MS) -> str:
    """Open scans of which nothing was heard for ``timeout_ms`` of event time, as failed, with the time at which they failed.

    ``events(scan_id, seq, status, ts)``; ``lateness`` is the watermark's delay. Timers of the state store do it: a scan
    that falls silent is failed by the stream itself. Returns the data folder.
    """
    rows = events.select("scan_id", F.col("seq").cast("long").alias("seq"), "status", "ts", F.unix_millis("ts").alias("at_ms"))
    out = f"{_ddl(rows, ['scan_id'])}, failed_at_ms long, status string, error string"
    stale = rows.withWatermark("ts", lateness).groupBy("scan_id").transformWithState(StaleScans(timeout_ms, memory_ms), out, "Append", "EventTime")
    return run_to_files(stale, path)
