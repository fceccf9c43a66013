"""Registered queries: the streaming jobs, run over the stored tables until they are used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from findmill import constants as K
from findmill.plans import q_events as qe, q_ingest as qi, views as v
from findmill.session import work_dir
from findmill.streaming import jobs
from findmill.streaming.runner import checkpoint, read_table_stream, stream_session

Q: dict = {}


def _stream(spark, sf, name):
    session = stream_session(spark)
    return session, {name: read_table_stream(session, sf, name)}


def _in_parts(spark, sf, run: Callable, parts: int = 2):
    """Run ``run(session, tables)`` after each part of the events has arrived: the same stream, started anew from its checkpoint."""
    session, folder = stream_session(spark), work_dir(spark, "arrived")
    src = v.load(spark, sf, "events")
    first, last = src.agg(F.min("event_id"), F.max("event_id")).first()
    for i in range(parts):
        low, high = (first + (last + 1 - first) * k // parts for k in (i, i + 1))
        src.where(F.col("event_id").between(low, high - 1)).write.mode("append").parquet(folder)
        out = run(session, {"events": session.readStream.schema(src.schema).parquet(folder)})
    return out


def stream_report_ingest(spark, sf):
    session, tables = _stream(spark, sf, "lineitem")
    out = jobs.stream_report_ingest(qi.mixed_reports(session, sf, tables), work_dir(spark, "ingest"))
    return spark.read.parquet(out).select(qi._OUT)


Q["stream_report_ingest"] = (stream_report_ingest, qi.Q["union_engines"][1])


def stream_dedup(spark, sf):
    session, tables = _stream(spark, sf, "lineitem")
    f = v.fingerprinted(session, sf, tables).select("finding_id", "scan_id", "fingerprint", F.col("first_seen").cast("timestamp").alias("seen"))
    out = jobs.stream_dedup(f, work_dir(spark, "dedup"), "seen", "3650 days", row_id=F.col("finding_id"))
    return spark.read.parquet(out).select("scan_id", "fingerprint")


Q["stream_dedup"] = (stream_dedup, f"SELECT scan_id, fingerprint FROM ({v.D_DEDUPED})")


def stream_engine_state(spark, sf):
    path = work_dir(spark, "state")
    state = _in_parts(spark, sf, lambda session, tables: jobs.stream_engine_state(v.events(session, sf, tables), path, "event_id"))
    return jobs.engine_state_view(spark, state)


Q["stream_engine_state"] = (stream_engine_state, v.D_ENGINE_RUNS)


def stream_event_buffer(spark, sf):
    path = work_dir(spark, "buffer")

    def run(session, tables):
        e = v.events(session, sf, tables).select("event_id", "scan_id", "event_type")
        return jobs.stream_event_buffer(e, path, ["event_id"], qe.RING)

    _in_parts(spark, sf, run)
    return jobs.ring_view(spark, checkpoint(path)).select("event_id", "scan_id", "seq")


Q["stream_event_buffer"] = (stream_event_buffer, qe.Q["event_ring"][1])


def stream_progress(spark, sf):
    path = work_dir(spark, "progress")
    out = _in_parts(spark, sf, lambda session, tables: jobs.stream_progress(v.events(session, sf, tables), path, ["event_id"]))
    return spark.read.parquet(out).select("event_id", "scan_id", "pct")


Q["stream_progress"] = (stream_progress, qe.D_PROGRESS)


def _triage(spark, sf):
    path = work_dir(spark, "triage")
    return _in_parts(spark, sf, lambda session, tables: jobs.stream_triage(v.triage(session, sf, tables), path)), path


def stream_triage(spark, sf):
    return spark.read.parquet(_triage(spark, sf)[0]).select("finding_id", "seq", "from_status", "to_status", "reason")


Q["stream_triage"] = (stream_triage, qe.D_AUDIT)
Q["stream_triage_current"] = (lambda s, d: jobs.triage_view(s, checkpoint(_triage(s, d)[1])).where("seq IS NOT NULL"), qe.D_CURRENT)

_LIFE = """
SELECT user_id AS scan_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'succeeded'
       WHEN 'purchase' THEN 'pending' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'pending' END
       ELSE CASE WHEN event_id % 4 = 0 THEN 'aborted' ELSE 'pending' END END AS status
FROM {events}
"""
_D_FIRST = (
    f"SELECT scan_id, min(seq) FILTER (status = 'running') AS run, min(seq) FILTER (status IN ('failed', 'aborted')) AS bad FROM ({v.duck(_LIFE)}) GROUP BY scan_id"
)
_D_ENDS = (
    "SELECT f.scan_id, run, least(bad, min(e.seq) FILTER (e.status = 'succeeded' AND e.seq > run)) AS stop "
    f"FROM ({_D_FIRST}) f JOIN ({v.duck(_LIFE)}) e ON f.scan_id = e.scan_id GROUP BY f.scan_id, run, bad"
)


def _lifecycle(spark, sf, arrive="true"):
    path = work_dir(spark, "lifecycle")
    return _in_parts(spark, sf, lambda session, tables: jobs.stream_scan_lifecycle(v._run(session, sf, _LIFE, tables).where(arrive), path)), path


def stream_scan_lifecycle(spark, sf):
    return spark.read.parquet(_lifecycle(spark, sf)[0]).select("scan_id", "seq", "status")


Q["stream_scan_lifecycle"] = (
    stream_scan_lifecycle,
    f"WITH x AS ({_D_ENDS}), l AS ({v.duck(_LIFE)}) SELECT scan_id, run AS seq, 'running' AS status FROM x WHERE run IS NOT NULL AND (stop IS NULL OR run < stop) "
    "UNION ALL SELECT x.scan_id, stop, l.status FROM x JOIN l ON x.scan_id = l.scan_id AND x.stop = l.seq UNION ALL SELECT scan_id, stop, '__end__' FROM x WHERE stop IS NOT NULL",
)


# Scans with every ending event of odd number lost; one fails when it is silent for two days.
_SILENCE_H, _LATE_H = 48, 1
_LIFE_TS = _LIFE.replace("event_id AS seq,", "event_id AS seq, ts,")
_LOST = "(status IN ('running', 'pending') OR (seq % 2 = 0 AND scan_id % 3 = 0))"


def stream_recover_stale(spark, sf):
    path = work_dir(spark, "recover")

    def run(session, tables):
        life = v._run(session, sf, _LIFE_TS, tables).where(_LOST).withColumn("ts", F.col("ts").cast("timestamp"))
        return jobs.stream_stale_scans(life, path, _SILENCE_H * 3_600_000, f"{_LATE_H} hours")

    return spark.read.parquet(_in_parts(spark, sf, run))


_D_LOST = f"SELECT *, epoch_us(ts) // 1000 AS ms FROM ({v.duck(_LIFE_TS)}) WHERE {_LOST}"
Q["stream_recover_stale"] = (
    stream_recover_stale,
    f"WITH l AS ({_D_LOST}), o AS (SELECT *, lag(ms) OVER w AS before, bool_or(status = 'running') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ran FROM l WINDOW w AS (PARTITION BY scan_id ORDER BY ms, seq)), "
    f"x AS (SELECT *, CASE WHEN ms - before > {_SILENCE_H} * 3600000 THEN 'silent' WHEN status IN ('failed', 'aborted') OR (status = 'succeeded' AND ran) THEN 'end' END AS stop FROM o), "
    "f AS (SELECT scan_id, arg_min(stop, (ms, seq)) FILTER (stop IS NOT NULL) AS stop, arg_min(before, (ms, seq)) FILTER (stop IS NOT NULL) AS before, max(ms) AS last FROM x GROUP BY scan_id), "
    "t AS (SELECT scan_id, CASE WHEN stop IS NULL THEN last WHEN stop = 'silent' THEN before END + "
    f"{_SILENCE_H} * 3600000 AS failed_at_ms FROM f) "
    f"SELECT scan_id, failed_at_ms, 'failed' AS status, '{K.RECOVERY_MESSAGE}' AS error FROM t WHERE failed_at_ms <= (SELECT max(ms) FROM l) - {_LATE_H} * 3600000 OR (failed_at_ms IS NOT NULL AND scan_id IN (SELECT scan_id FROM f WHERE stop = 'silent'))",
)

Q["stream_open_scans"] = (
    lambda s, d: jobs.open_scans(s, checkpoint(_lifecycle(s, d, _LOST)[1])),
    f"WITH l AS ({_D_LOST}), f AS (SELECT scan_id, min(seq) FILTER (status = 'running') AS run, min(seq) FILTER (status IN ('failed', 'aborted')) AS bad FROM l GROUP BY scan_id), "
    "x AS (SELECT f.scan_id, run, least(bad, min(l.seq) FILTER (l.status = 'succeeded' AND l.seq > run)) AS stop FROM f JOIN l ON f.scan_id = l.scan_id GROUP BY f.scan_id, run, bad) "
    "SELECT scan_id, CASE WHEN run IS NULL THEN 'pending' ELSE 'running' END AS status FROM x WHERE stop IS NULL",
)
