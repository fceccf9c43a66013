"""Stored findings under triage, the end of scans, detectors called from SQL."""

import pytest
from pyspark.sql import functions as F

from findmill.operators import detectors, scans as sc
from findmill.operators.findings import findings_query
from findmill.plans import q_jobs, views as v
from findmill.sources import findings_store as store, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = v.findings(spark, SF).select("finding_id", "scan_id", "severity", "status", "project_id", "tool", "source_type", "rule_id", "file_path", "description", "in_pr_diff")
    store.create_findings(rows.withColumn("triage_reason", F.lit("")), path, "r0", 8)
    return path


def files_of(path):
    import pathlib

    return {str(p) for p in pathlib.Path(path, "files").rglob("*.parquet")}


def current(spark, *rows):
    return spark.createDataFrame(rows, "finding_id long, status string, triage_reason string")


def test_merge_rewrites_changed_buckets_only(spark, stored):
    one = store.read_findings(spark, stored).where("status = 'new'").first()["finding_id"]
    before, count = files_of(stored), store.read_findings(spark, stored).count()
    assert store.merge_triage(spark, stored, current(spark, (one, "fixed", "done"), (-5, "fixed", "no such finding")), "m1") == 1
    now = store.read_findings(spark, stored)
    assert now.count() == count and before < files_of(stored)
    # every file that the table reads now was there before, but for those of one bucket
    assert len({f.rsplit("/_bucket=", 1)[1].split("/")[0] for f in now.inputFiles() if "version=m1" in f}) == 1
    assert {f.removeprefix("file://") for f in now.inputFiles() if "version=r0" in f} < before
    row = findings_query(now.where(F.col("finding_id") == one), status="fixed").first()
    assert (row["status"], row["triage_reason"]) == ("fixed", "done")


def test_merges_can_be_repeated(spark, stored):
    ids = [r[0] for r in store.read_findings(spark, stored).select("finding_id").orderBy("finding_id").limit(30).collect()]
    change = current(spark, *[(i, "accepted_risk", None) for i in ids])
    store.merge_triage(spark, stored, change, "m1")
    want = sorted(store.read_findings(spark, stored).select("finding_id", "status").collect())
    names = files_of(stored)
    assert store.merge_triage(spark, stored, change, "m1") == 0
    assert files_of(stored) == names and sorted(store.read_findings(spark, stored).select("finding_id", "status").collect()) == want
    assert {s for i, s in want if i in ids} == {"accepted_risk"}


def test_a_merge_that_was_cut_off_does_not_count(spark, stored, monkeypatch):
    one = store.read_findings(spark, stored).first()["finding_id"]

    def stop(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", stop)
        with pytest.raises(RuntimeError):
            store.merge_triage(spark, stored, current(spark, (one, "triaged", "a")), "m1")
    assert store.read_findings(spark, stored).where(F.col("triage_reason") == "a").isEmpty()
    store.merge_triage(spark, stored, current(spark, (one, "triaged", "a")), "m1")
    assert store.read_findings(spark, stored).where(F.col("triage_reason") == "a").count() == 1


def test_empty_table_and_empty_merge(spark, stored, tmp_path):
    path = str(tmp_path / "none")
    store.create_findings(store.read_findings(spark, stored).where("false"), path, "r0")
    assert store.merge_triage(spark, path, current(spark, (1, "fixed", "x")), "m") == 0
    assert store.merge_triage(spark, stored, current(spark), "m") == 0
    assert store.read_findings(spark, stored).count() == v.findings(spark, SF).count()


def test_end_of_scans(spark):
    """A malformed report fails its scan but others' findings are kept; a scan of unavailable engines only has failed."""
    runs = spark.createDataFrame(
        [(1, "bandit", 0), (1, "gitleaks", 0), (2, "bandit", None), (3, "bandit", 1), (3, "trivy", None), (4, "opengrep", 3)], "scan_id long, engine string, exit_code int"
    ).withColumns({"stderr": F.lit("bad rule"), "timed_out": F.lit(False), "retry_exit_code": F.lit(None).cast("int"), "retry_stderr": F.lit(None).cast("string")})
    envelopes = spark.createDataFrame([(1, "bandit", "malformed_output", "invalid JSON"), (1, "gitleaks", None, None), (3, "bandit", None, None)], "scan_id long, engine string, kind string, reason string")
    found = spark.createDataFrame([(1, "gitleaks", "high"), (1, "bandit", "low"), (3, "bandit", "low"), (3, "bandit", "low")], "scan_id long, tool string, severity string")
    states = sc.engine_states(runs, envelopes)
    kept = sc.completed_findings(found, states)
    scans = spark.createDataFrame([(i, "running", "") for i in range(1, 6)], "scan_id long, status string, error string")
    rows = {r.scan_id: r for r in sc.finish_scans(scans, sc.scan_outcome(states, kept, kept), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert [rows[i].status for i in range(1, 6)] == ["failed", "failed", "succeeded", "failed", "running"]
    assert rows[1].engine_statuses["bandit"].asDict() == {"state": "failed", "findings": None, "reason": "bandit: invalid JSON", "kind": "malformed_output"}
    assert rows[1].engine_statuses["gitleaks"].findings == 1 and rows[1].summary.total == 1 and rows[1].summary.by_severity == {"high": 1}
    assert rows[2].error.startswith("no scanner") and rows[3].summary.engines == {"done": 1, "unavailable": 1} and rows[3].engine_statuses["bandit"].findings == 2
    assert rows[4].engine_statuses["opengrep"].kind == "rule_config" and rows[5].finished_at is None and rows[3].finished_at is not None


def test_detectors_from_sql(spark):
    files = spark.createDataFrame([("p", "a.py", "x = 1\neval(y)\n"), ("p", "b.py", "")], "project string, path string, content string")
    files.createOrReplaceTempView("some_files")
    detectors.sql_detector(spark, "evals", "sast", lambda project, path, content: [{"rule_id": "e", "line_start": n} for n, x in enumerate(content.split("\n"), 1) if "eval" in x])
    row = spark.sql("SELECT * FROM evals(TABLE(some_files))").collect()
    assert [(r.project, r.file_path, r.line_start, r.tool, r.source_type, r.severity, r.cwe, r.redaction_tokens) for r in row] == [("p", "a.py", 2, "evals", "sast", "low", "", [])]
    with pytest.raises(Exception, match="malformed_output"):
        spark.sql("SELECT * FROM evals(TABLE(SELECT project, path FROM some_files))").collect()
    detectors.sql_detector(spark, "wrong", "sast", lambda project, path, content: [{"line_start": "two"}])
    with pytest.raises(Exception, match="malformed_output"):
        spark.sql("SELECT * FROM wrong(TABLE(some_files))").collect()
    with pytest.raises(detectors.DetectorError):
        detectors.sql_detector(spark, "other", "guess", lambda *a: [])


def test_runs_of_one_table_are_computed_and_shuffled_once(spark, monkeypatch):
    """Each run is written whole, from a stored copy that lies as the files shall."""
    plans, rows, write = [], [], sinks._replace

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        rows.append(df.count())
        write(df, *args)

    monkeypatch.setattr(sinks, "_replace", seen)
    stored = q_jobs.sink_findings(spark, SF)
    assert len(plans) == 4 and not any(x in p for p in plans for x in ("Exchange", "Window", "Join"))
    assert rows[0] == rows[1] == rows[2] == stored.count() > 0 == rows[3]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 200000, 1, 8).selectExpr("id AS finding_id", "id AS scan_id", "sha2(string(id), 256) AS severity", "'new' AS status", "'' AS triage_reason")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        store.create_findings(rows, str(tmp_path / "f"), "r0", 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = files_of(str(tmp_path / "f"))
    assert {f.rsplit("/_bucket=", 1)[1].split("/")[0] for f in files} == {"0", "1"} and len(files) > 6
    assert store.read_findings(spark, str(tmp_path / "f")).count() == 200000


def test_changes_are_computed_once(spark, stored):
    """A merge looks at them three times."""
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    ids = [r[0] for r in store.read_findings(spark, stored).select("finding_id").limit(20).collect()]
    change = current(spark, *[(i, "fixed", "done") for i in ids]).withColumn("status", F.udf(counted, "string", useArrow=False)("status"))
    store.merge_triage(spark, stored, change, "m1")
    assert calls.value == 20 and store.read_findings(spark, stored).where("triage_reason = 'done'").count() == 20
