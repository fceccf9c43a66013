import json

import pytest
from pyspark.sql import functions as F

from findmill import schemas as S
from findmill.operators.findings import finding_detail, findings_query
from findmill.operators.report import report_blocks
from findmill.plans.scan_job import scan_findings, store_scan
from findmill.sources import reports as rp
from findmill.sources.sinks import sink_findings

SECRET = "sk_" + "live_" + "0123456789abcdefXYZ"


def table(spark, *rows):
    return spark.createDataFrame([(str(i), 1, "p", e, b) for i, (e, b) in enumerate(rows)], "report_id string, scan_id long, project string, engine string, body string")


@pytest.mark.parametrize(
    "engine, body, good",
    [("bandit", "not-json", False), ("bandit", "{}", False), ("bandit", '{"results": []}', True), ("bandit", '{"results": {}}', False), ("bandit", "[]", False),
     ("opengrep", "nope", False), ("opengrep", "{}", False), ("opengrep", "", False), ("opengrep", '{"results": []}', True),
     ("gitleaks", "not-json", False), ("gitleaks", "{}", False), ("gitleaks", "[]", True), ("trivy", "{}", False),
     ("trivy", '{"SchemaVersion": 2, "ArtifactName": "x"}', True), ("trivy", '{"SchemaVersion": 2, "ArtifactName": "x", "Results": null}', True),
     ("trivy", '{"SchemaVersion": "2", "ArtifactName": "x"}', False), ("trivy", '{"SchemaVersion": 2, "ArtifactName": "x", "Results": {}}', False),
     ("trivy", '{"SchemaVersion": 2, "ArtifactName": 1}', False)],
)
def test_envelope(spark, engine, body, good):
    row = rp.ingest_report_envelope(table(spark, (engine, body))).first()
    assert (row["kind"] is None) is good
    assert good or row["kind"] == "malformed_output"


def test_trivy_levels_and_nulls(spark):
    v = {"VulnerabilityID": "CVE-1", "PkgName": "a", "InstalledVersion": "1", "Severity": "UNKNOWN", "Description": "d" * 1200, "CweIDs": ["CWE-5", "CWE-6"]}
    doc = {"SchemaVersion": 2, "ArtifactName": "x", "Results": [{"Target": "lock", "Vulnerabilities": None}, {"Target": "req", "Vulnerabilities": [v, {**v, "FixedVersion": "2", "References": ["u", "w"]}]}]}
    a, b = rp.ingest_trivy(table(spark, ("trivy", json.dumps(doc)))).orderBy("ordinal").collect()
    assert (a["severity"], a["cwe"], a["file_path"], len(a["description"]), a["line_start"]) == ("info", "CWE-5", "req", 1000, None)
    assert (a["remediation"], b["remediation"]) == ("Upgrade a from 1", "Upgrade a from 1 to 2. See: u")


def test_opengrep_severity_and_rule(spark):
    def hit(**extra):
        return {"check_id": "home.scp.a", "path": "x.py", "start": {"line": 3, "col": 1}, "end": {"line": 4, "col": 2}, "extra": extra}

    doc = {"results": [hit(severity="INFO", metadata={"category": "security"}), hit(metadata={"severity": "note"}), hit(lines=" requires login "), hit(severity="ERROR", lines="a\nb")]}
    rows = rp.ingest_opengrep(table(spark, ("opengrep", json.dumps(doc)))).orderBy("ordinal").collect()
    assert [r["severity"] for r in rows] == ["medium", "info", "medium", "high"]
    assert [r["snippet"] for r in rows] == [None, None, None, "a\nb"] and rows[0]["rule_id"] == "scp.a"


def test_zap_risk(spark):
    alerts = [{"risk": r, "url": "u"} for r in ("3", "2", "1", "0", "High", None)]
    rows = rp.ingest_zap_alerts(table(spark, ("zap", json.dumps({"alerts": alerts})))).orderBy("ordinal").collect()
    assert [r["severity"] for r in rows] == ["high", "medium", "low", "info", "info", "info"]


def test_gitleaks_keeps_secret_out_of_all_but_the_token(spark):
    doc = [{"RuleID": "k", "File": "a", "StartLine": 2, "EndLine": 2, "Secret": SECRET, "Match": f"key={SECRET}", "Description": "d"}]
    row = rp.ingest_gitleaks(table(spark, ("gitleaks", json.dumps(doc)))).first()
    assert row["redaction_tokens"] == [SECRET] and SECRET not in str({**row.asDict(), "redaction_tokens": None})
    assert row["severity"] == "high" and row["snippet"] == "key=[REDACTED]"


@pytest.fixture
def job(spark):
    """Two spellings of one path, one leak, one pull-request change."""
    bandit = {"results": [{"test_id": "B1", "filename": f, "line_number": 2, "code": "2    bad()\n", "issue_severity": "LOW"} for f in ("/w/p/src/x.py", "src/x.py", "src/y.py")]}
    leak = [{"RuleID": "r", "File": "/w/p/src/x.py", "StartLine": 3, "EndLine": 3, "Secret": "plainsecretword", "Match": "is plainsecretword"}]
    grep = {"results": [{"check_id": "c", "path": "src/x.py", "start": {"line": 3, "col": 1}, "end": {"line": 3, "col": 9}, "extra": {"severity": "ERROR"}}]}
    reports = table(spark, ("bandit", json.dumps(bandit)), ("gitleaks", json.dumps(leak)), ("opengrep", json.dumps(grep)), ("trivy", "broken"))
    files = spark.createDataFrame([("p", "src/x.py", f"one\ntwo plainsecretword\nkey {SECRET}\n")], "project string, path string, content string")
    ranges = spark.createDataFrame([(1, "src/x.py", 1, 2)], "scan_id long, path string, start int, end int")
    return reports, files, ranges, F.concat(F.lit("/w/"), "project")


def test_scan_job(spark, job):
    rows = {(r["tool"], r["file_path"]): r for r in scan_findings(*job).collect()}
    assert set(rows) == {("bandit", "src/x.py"), ("bandit", "src/y.py"), ("gitleaks", "src/x.py"), ("opengrep", "src/x.py")}
    assert rows["bandit", "src/x.py"]["in_pr_diff"] and not rows["opengrep", "src/x.py"]["in_pr_diff"]
    # Exact tokens reach the context of secret findings only; patterns reach all.
    leak, other = rows["gitleaks", "src/x.py"]["evidence"], rows["bandit", "src/x.py"]["evidence"]
    assert "plainsecretword" not in leak and "plainsecretword" in other
    assert all(SECRET not in str(r.asDict()) for r in rows.values())
    assert rows["opengrep", "src/x.py"]["snippet"] == "key [REDACTED]"
    assert json.loads(other)["start"]["line"] == 2 and "cwe" not in json.loads(other)


def test_deleted_scan_writes_nothing(spark, job):
    gone = spark.createDataFrame([(2,)], "scan_id long")
    assert scan_findings(*job, gone).count() == 0


def test_stored_findings_hold_no_secret_and_runs_do_not_touch_each_other(spark, job, tmp_path):
    path = str(tmp_path / "findings")
    for run in ("a", "b", "a"):
        store_scan(*job, path, run)
    assert {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"a": 4, "b": 4}
    assert not {"redaction_tokens", "raw"} & set(spark.read.parquet(path).columns)
    out = spark.read.parquet(path).selectExpr("to_json(struct(*)) AS j").collect()
    assert not any(SECRET in r["j"] for r in out)


def test_sink_drops_transient_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "f", "low", ["tok"], "raw")], "scan_id long, fingerprint string, severity string, redaction_tokens array<string>, raw string")
    sink_findings(df, str(tmp_path / "s"), "r")
    assert set(spark.read.parquet(str(tmp_path / "s")).columns) == {"scan_id", "fingerprint", "severity", "run_id"}


def test_stored_findings_serve_the_reads(spark, job, tmp_path):
    path = str(tmp_path / "findings")
    scans = spark.createDataFrame([(1, 7, "dast")], "scan_id long, project_id long, scan_type string")
    store_scan(*job, path, "a", scans, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    stored = spark.read.parquet(path)
    assert set(S.FINDING.fieldNames()) <= set(stored.columns) and stored.select("finding_id").distinct().count() == 4
    assert findings_query(stored, project_id=7, limit=10).count() == 4
    assert report_blocks(stored).count() == 4 and finding_detail(stored, stored.first()["finding_id"]).count() == 1


def test_quarantined_reports_give_no_rows(spark):
    vulnerable = {"Results": [{"Target": "t", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "Severity": "HIGH"}]}]}
    good = {"SchemaVersion": 2, "ArtifactName": "a", **vulnerable}
    rows = rp.ingest_all(table(spark, ("trivy", json.dumps(vulnerable)), ("trivy", json.dumps(good)), ("zap", "{}"), ("zap", "[]"))).collect()
    assert [r["rule_id"] for r in rows] == ["CVE-1"]
    kinds = [r["kind"] for r in rp.ingest_report_envelope(table(spark, ("trivy", json.dumps(vulnerable)), ("zap", "{}"), ("zap", "[]"))).collect()]
    assert kinds == ["malformed_output", None, "malformed_output"]


def test_addresses_of_dast_findings_stay(spark, job):
    _, files, ranges, root = job
    alert = {"alerts": [{"pluginId": "1", "url": "https://h.example/a?b=1", "risk": "2", "confidence": "High"}]}
    row = scan_findings(table(spark, ("zap", json.dumps(alert))), files, ranges, root).first()
    assert row["file_path"] == "https://h.example/a?b=1" and json.loads(row["evidence"])["confidence"].lower() == "high"


def test_entries_are_cut_out_once(spark):
    """One list per engine and one below trivy's targets; fields come from one pass over an entry, not from a path each."""
    plan = rp.ingest_all(table(spark, ("bandit", "{}")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrayType(VariantType") == 6
    assert "$.extra.metadata" not in plan and "$.issue_cwe" not in plan


def test_entries_of_odd_types(spark):
    bandit = {"results": [7, None, {"test_id": 5, "line_number": "12", "col_offset": 1.5, "end_col_offset": 3_000_000_000, "issue_cwe": 3, "code": ["x"], "filename": None}]}
    grep = {"results": [{"check_id": "a", "start": [1], "end": {"line": True}, "extra": {"severity": 1, "metadata": "m"}}, {"extra": {"metadata": {"cwe": None, "severity": "HIGH "}}}]}
    trivy = {"SchemaVersion": 1, "ArtifactName": "", "Results": [{"Target": 1, "Vulnerabilities": [{"CweIDs": "CWE-1", "References": {}}, {"CweIDs": [9]}]}]}
    rows = rp.ingest_all(table(spark, ("bandit", json.dumps(bandit)), ("opengrep", json.dumps(grep)), ("trivy", json.dumps(trivy)))).orderBy("report_id", "ordinal").collect()
    assert [(r.tool, r.rule_id, r.line_start, r.col_start, r.col_end, r.line_end) for r in rows[:3]] == [
        ("bandit", "", None, None, None, None), ("bandit", "", None, None, None, None), ("bandit", "5", 12, 1, None, 12)]
    assert [(r.severity, r.cwe, r.line_start, r.line_end) for r in rows[3:5]] == [("low", "", None, 1), ("high", "", None, None)]
    assert [(r.cwe, r.file_path, r.remediation) for r in rows[5:]] == [("", "1", "Upgrade  from "), ("9", "1", "Upgrade  from ")]
