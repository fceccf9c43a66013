"""Registered queries: event buffers, progress, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill.operators import events as ev, triage as tr
from findmill.operators.ordered import chunk_of
from findmill.plans import views as v

Q: dict = {}
RING = 20
# Chunk width in event ids; ids rise along every scan.
CHUNK = 1000


def chunk(column: str):
    return chunk_of(column, CHUNK)


def sequenced(spark, sf):
    return ev.event_seq(v.events(spark, sf), ["event_id"], chunk("event_id"))


D_SEQ = f"SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY event_id) AS seq FROM ({v.D_EVENTS})"
D_RING = f"SELECT *, max(seq) OVER (PARTITION BY scan_id) AS last_seq FROM ({D_SEQ})"
Q["event_seq"] = (lambda s, d: sequenced(s, d).select("event_id", "scan_id", "seq"), f"SELECT event_id, scan_id, seq FROM ({D_SEQ})")
Q["event_ring"] = (
    lambda s, d: ev.event_ring(sequenced(s, d), RING).select("event_id", "scan_id", "seq"),
    f"SELECT event_id, scan_id, seq FROM ({D_RING}) WHERE seq > last_seq - {RING}",
)


def events_since(spark, sf):
    """A cursor for every scan, at a place that depends on its number."""
    seq = sequenced(spark, sf)
    cursors = seq.select("scan_id").distinct().select("scan_id", (F.col("scan_id") % 70).alias("after_seq"))
    return ev.events_since(seq, cursors, RING).select("event_id", "scan_id", "seq", "last_seq")


Q["events_since"] = (
    events_since,
    f"SELECT event_id, scan_id, seq, last_seq FROM ({D_RING}) WHERE seq > greatest(scan_id % 70, last_seq - {RING})",
)
Q["latest_event"] = (
    lambda s, d: ev.latest_event(sequenced(s, d), ["event_type", "props"]),
    f"SELECT scan_id, seq, event_type, props FROM ({D_RING}) WHERE seq = last_seq",
)

D_PROGRESS = (
    "SELECT event_id, scan_id, pct FROM (SELECT *, lag(pct, 1, -1) OVER (PARTITION BY scan_id ORDER BY event_id) AS prev FROM "
    "(SELECT *, min(CASE WHEN pct >= 100 THEN event_id END) OVER (PARTITION BY scan_id) AS stop FROM "
    f"(SELECT event_id, scan_id, coalesce(try_cast(status AS bigint), 0) AS pct FROM ({v.D_EVENTS}))) WHERE stop IS NULL OR event_id <= stop) WHERE pct <> prev"
)
Q["progress_changes"] = (
    lambda s, d: ev.progress_changes(v.events(s, d).select("event_id", "scan_id", "status"), ["scan_id"], ["event_id"], chunk("event_id")).select("event_id", "scan_id", "pct"),
    D_PROGRESS,
)

D_AUDIT = (
    "SELECT finding_id, seq, from_status, to_status, reason FROM (SELECT *, lag(to_status, 1, 'new') OVER (PARTITION BY finding_id ORDER BY seq) AS from_status "
    f"FROM ({v.D_TRIAGE}) WHERE to_status <> 'banana') WHERE from_status <> to_status"
)
D_CURRENT = f"SELECT finding_id, arg_max(to_status, seq) AS status, arg_max(reason, seq) AS triage_reason, max(seq) AS seq FROM ({D_AUDIT}) GROUP BY finding_id"


def audit(spark, sf):
    return tr.triage_apply(v.triage(spark, sf), chunk("seq")).select("finding_id", "seq", "from_status", "to_status", "reason")


Q["triage_apply"] = (audit, D_AUDIT)
Q["triage_rejected"] = (
    lambda s, d: tr.triage_rejected(v.triage(s, d)).select("finding_id", "seq"),
    f"SELECT finding_id, seq FROM ({v.D_TRIAGE}) WHERE to_status = 'banana'",
)
Q["triage_current"] = (lambda s, d: tr.triage_current(audit(s, d)), D_CURRENT)
Q["audit_trail"] = (lambda s, d: tr.audit_trail(audit(s, d)), D_AUDIT + " ORDER BY seq DESC")
