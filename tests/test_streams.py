"""Streams in several micro-batches give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from findmill.operators import events as ev, triage as tr
from findmill.plans import q_events as qe, q_streams as qs, views as v
from findmill.streaming import jobs
from findmill.streaming.runner import checkpoint, read_table_stream, stream_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The events in five files, read one per micro-batch in their order."""
    import os
    import time

    folder = tmp_path_factory.mktemp("feed")
    src = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(5):
        src.where(F.col("event_id").between(i * 200, i * 200 + 199)).toPandas().to_parquet(folder / f"events{i}.parquet", coerce_timestamps="us")
        os.utime(folder / f"events{i}.parquet", (time.time() - 1000 + i * 10,) * 2)
    session = stream_session(spark)
    return session, lambda: {"events": read_table_stream(session, str(folder), "events", files_per_batch=1)}


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def parts(spark, tmp_path, run, cuts=(0, 400, 401, 1000)):
    """``run`` over the events as they arrive part by part, each time from the checkpoint of the time before."""
    session, folder = stream_session(spark), str(tmp_path / "arrived")
    src = spark.read.parquet(f"{SF}/events.parquet")
    for low, high in zip(cuts, cuts[1:], strict=False):
        src.where(F.col("event_id").between(low, high - 1)).write.mode("append").parquet(folder)
        out = run(session, {"events": session.readStream.schema(src.schema).parquet(folder)})
    return out


def test_buffer(spark, feed, tmp_path):
    session, tables = feed
    data = jobs.stream_event_buffer(v.events(session, SF, tables()).select("event_id", "scan_id", "event_type"), str(tmp_path / "a"), ["event_id"], 3)
    want = rows(ev.event_ring(qe.sequenced(spark, SF), 3), "event_id", "scan_id", "seq")
    ring = jobs.ring_view(spark, checkpoint(str(tmp_path / "a")))
    assert rows(ring, "event_id", "scan_id", "seq") == want
    # what came out over time holds the ring, no number twice, and only true numbers
    out = rows(spark.read.parquet(data), "event_id", "scan_id", "seq")
    assert set(want) < set(out) and len(out) == len({r[1:] for r in out}) and set(out) <= set(rows(qe.sequenced(spark, SF), "event_id", "scan_id", "seq"))


def test_buffer_goes_on_after_restarts(spark, tmp_path):
    path = str(tmp_path / "b")
    parts(spark, tmp_path, lambda session, tables: jobs.stream_event_buffer(v.events(session, SF, tables), path, ["event_id"], 5))
    want = ev.event_ring(qe.sequenced(spark, SF), 5)
    cols = ("event_id", "scan_id", "seq", "event_type", "props")
    assert rows(jobs.ring_view(spark, checkpoint(path)), *cols) == rows(want, *cols)


def test_progress(spark, feed, tmp_path):
    session, tables = feed
    out = jobs.stream_progress(v.events(session, SF, tables()), str(tmp_path), ["event_id"])
    want = ev.progress_changes(v.events(spark, SF), ["scan_id"], ["event_id"], qe.chunk("event_id"))
    assert rows(spark.read.parquet(out), "event_id", "pct") == rows(want, "event_id", "pct")


AUDIT = ("finding_id", "seq", "from_status", "to_status", "reason")


def test_triage(spark, feed, tmp_path):
    session, tables = feed
    data = jobs.stream_triage(v.triage(session, SF, tables()), str(tmp_path))
    assert rows(spark.read.parquet(data), *AUDIT) == rows(qe.audit(spark, SF), *AUDIT)
    now, cols = tr.triage_current(qe.audit(spark, SF)), ("finding_id", "status", "triage_reason", "seq")
    assert rows(jobs.triage_view(spark, checkpoint(str(tmp_path))), *cols) == rows(now, *cols)


def test_triage_starts_from_stored_findings(spark, tmp_path):
    """Late start on findings that have a status, a restart in between, and findings that never change."""
    stored = spark.createDataFrame([(i, "triaged" if i % 2 else "fixed", f"was {i}") for i in range(1, 40)], "finding_id long, status string, triage_reason string")
    path = str(tmp_path / "t")

    def run(session, tables):
        own = session.createDataFrame(stored.collect(), stored.schema)
        return jobs.stream_triage(v.triage(session, SF, tables), path, own)

    data = parts(spark, tmp_path, run)
    want = tr.triage_apply(v.triage(spark, SF), qe.chunk("seq"), stored)
    assert rows(spark.read.parquet(data), *AUDIT) == rows(want, *AUDIT)
    now = {r.finding_id: (r.status, r.triage_reason) for r in tr.triage_current(want).collect()}
    held = {r.finding_id: (r.status, r.triage_reason) for r in jobs.triage_view(spark, checkpoint(path)).collect()}
    assert held == {r.finding_id: (r.status, r.triage_reason) for r in stored.collect()} | now and len(held) > len(now)


def test_lifecycle(spark, feed, tmp_path):
    session, tables = feed
    data = jobs.stream_scan_lifecycle(v._run(session, SF, qs._LIFE, tables()), str(tmp_path))
    want = jobs.lifecycle(v._run(spark, SF, qs._LIFE))
    assert rows(spark.read.parquet(data), "scan_id", "seq", "status") == rows(want, "scan_id", "seq", "status")


def test_only_open_scans_have_a_status(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "l")
    session = stream_session(spark)
    schema = "scan_id long, seq long, status string"
    for given in ([(1, 1, "pending"), (2, 1, "running"), (3, 1, "running"), (4, 1, "succeeded")], [(2, 2, "failed"), (3, 2, "succeeded"), (5, 1, "aborted")], [(2, 3, "running"), (1, 2, "running")]):
        spark.createDataFrame(given, schema).write.mode("append").parquet(folder)
        data = jobs.stream_scan_lifecycle(session.readStream.schema(schema).parquet(folder), path)
    assert rows(jobs.open_scans(spark, checkpoint(path)), "scan_id", "status") == [(1, "running"), (4, "pending")]
    assert [r[1:] for r in rows(spark.read.parquet(data), "scan_id", "seq", "status") if r[0] == 2] == [(1, "running"), (2, "__end__"), (2, "failed")]


def test_silent_scans_fail_by_timer(spark, tmp_path):
    """By the timer once others move the watermark on, or by the gap to their own next event; never twice, never after an end."""
    folder, path = str(tmp_path / "in"), str(tmp_path / "s")
    session = stream_session(spark)
    hour = 3_600
    batches = [
        [(1, 1, "running", 0), (2, 1, "running", 0), (3, 1, "running", 0), (3, 2, "succeeded", hour), (4, 1, "pending", 0)],
        [(2, 2, "running", 9 * hour), (5, 1, "running", 9 * hour), (6, 1, "running", 2 * hour), (6, 2, "running", 13 * hour)],
        [(5, 2, "running", 18 * hour), (1, 2, "running", 18 * hour)],
        [(7, 1, "running", 30 * hour)],
    ]
    for given in batches:
        df = spark.createDataFrame(given, "scan_id long, seq long, status string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1000 * hour))
        df.write.mode("append").parquet(folder)
        stream = session.readStream.schema(df.schema).parquet(folder)
        data = jobs.stream_stale_scans(stream, path, 10 * hour * 1000, "1 hour")
    got = [(i, at // hour // 1000 - 1000) for i, at in rows(spark.read.parquet(data), "scan_id", "failed_at_ms")]
    assert got == [(1, 10), (2, 19), (4, 10), (5, 28), (6, 12)]


def test_lifecycle_order(spark):
    given = [(1, 1, "succeeded"), (1, 2, "running"), (1, 3, "running"), (1, 4, "succeeded"), (1, 5, "failed"), (2, 1, "failed"), (2, 2, "running"), (3, 1, "running")]
    df = spark.createDataFrame(given, "scan_id long, seq long, status string")
    got = rows(jobs.lifecycle(df), "scan_id", "seq", "status")
    assert got == [(1, 2, "running"), (1, 4, "__end__"), (1, 4, "succeeded"), (2, 1, "__end__"), (2, 1, "failed"), (3, 1, "running")]


def test_engine_state(spark, feed, tmp_path):
    """Five micro-batches leave one row per key."""
    session, tables = feed
    out = jobs.stream_engine_state(v.events(session, SF, tables()), str(tmp_path), "event_id")
    assert jobs.engine_state_view(spark, out).count() == v.engine_runs(spark, SF).count()
    cols = ("scan_id", "engine", "state", "kind")
    assert rows(jobs.engine_state_view(spark, out), *cols) == rows(v.engine_runs(spark, SF), *cols)


def test_dedup_across_batches(spark, feed, tmp_path):
    """Two fingerprints for all events: one holds most of them, in every batch."""
    session, tables = feed
    e = v.events(session, SF, tables()).select(
        F.lit(1).cast("long").alias("scan_id"), "event_id", F.when(F.col("event_id") % 50 == 0, "rare").otherwise("hot").alias("fingerprint"), F.col("ts").cast("timestamp").alias("seen")
    )
    out = jobs.stream_dedup(e, str(tmp_path), "seen", "3650 days", row_id=F.col("event_id"))
    assert rows(spark.read.parquet(out), "scan_id", "fingerprint") == [(1, "hot"), (1, "rare")]


def test_report_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"results": [\n {"test_id": "B1", "filename": "x"}]}')
    (folder / "b.json").write_text("broken")
    session = stream_session(spark)
    out = jobs.stream_report_ingest(jobs.read_report_stream(session, str(folder), "bandit"), str(tmp_path / "out"))
    assert rows(spark.read.parquet(out), "report_id", "rule_id") == [("a.json", "B1")]
