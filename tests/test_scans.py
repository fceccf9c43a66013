import io
import zipfile

import pytest
from pyspark.sql import functions as F

from findmill.operators import archive, detectors, governance as g, projects as pj, scans as sc, summary, triage as tr
from findmill.operators.detect import Rule, compile_call_pattern, rule_scan, rule_scan_calls, rules_from_rows
from findmill.sources import archives, rulepack


def runs(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "scan_id long, engine string, state string, kind string")


@pytest.mark.parametrize(
    "rows, want",
    [([("bandit", "failed", "malformed_output"), ("gitleaks", "done", "")], ("failed", "one or more")),
     ([("bandit", "unavailable", "unavailable"), ("trivy", "unavailable", None)], ("failed", "no scanner")),
     ([("trivy", "done", "degraded")], ("succeeded", "")), ([("trivy", "done", None), ("zap", "skipped", None)], ("succeeded", ""))],
)
def test_verdict(spark, rows, want):
    row = summary.scan_verdict(runs(spark, *rows)).first()
    assert row["status"] == want[0] and row["error"].startswith(want[1])


def test_run_outcomes(spark):
    rate = "maven: 429 Too Many Requests\nRetry-After: 1800"
    rows = [("bandit", 1, "", False, None, "done", ""), ("bandit", 2, "", False, None, "failed", "execution"), ("opengrep", 2, "", False, None, "failed", "rule_config"),
            ("opengrep", 9, "", False, None, "failed", "execution"), ("gitleaks", 2, "", False, None, "failed", "execution"), ("trivy", 1, rate, False, 0, "done", "degraded"),
            ("trivy", 1, rate, False, 1, "failed", "execution"), ("trivy", 1, "other", False, 0, "failed", "execution"), ("zap", 0, "", True, None, "failed", "timeout")]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, engine string, exit_code int, stderr string, timed_out boolean, retry_exit_code int").withColumn("retry_stderr", F.lit("offline analyzer failed"))
    got = sc.engine_run_classify(df).orderBy("i").collect()
    assert [(r["state"], r["kind"]) for r in got] == [r[5:] for r in rows]
    assert got[5]["reason"].endswith("Retry-After: 1800.")
    assert rate in got[6]["reason"] and got[6]["reason"].endswith("offline fallback also failed: offline analyzer failed")


def test_admission(spark):
    projects = spark.createDataFrame([(1, "w"), (2, "")], "project_id long, workspace string")
    targets = spark.createDataFrame([(10, 1, "u", False, False), (11, 2, "u", True, True), (12, 1, "u", True, True)], "target_id long, project_id long, url string, is_production boolean, pre_approved boolean")
    cases = [((1, "sast", "branch", [], None, False), ""), ((9, "sast", "branch", [], None, False), "project not found"), ((2, "sast", "pr", [], None, False), "uploaded"),
             ((1, "dast", "branch", [], None, False), "dast scans"), ((1, "dast", "branch", [], "11", False), "target not found"), ((1, "dast", "branch", [], "10", False), "target is not pre"),
             ((1, "dast", "branch", [], "10", True), ""), ((1, "dast", "branch", [], "12", False), "target is production"), ((1, "sast", "branch", ["bandit", "foo"], None, False), "unknown engines: foo")]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, project_id long, scan_type string, ref_type string, engines array<string>, dast_target string, dast_confirmed boolean")
    got = sc.scan_admission(df, projects, targets).orderBy("i").collect()
    for row, (_, want) in zip(got, cases):
        assert row["reason"].startswith(want) and (row["decision"] == "accepted") is (want == "")


def test_recovery(spark):
    df = spark.createDataFrame([(1, "pending"), (2, "running"), (3, "succeeded")], "scan_id long, status string").withColumns({"error": F.lit(""), "finished_at": F.lit(None).cast("timestamp")})
    got = {r["scan_id"]: r for r in sc.recover_stale_scans(df, F.current_timestamp()).collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["failed", "failed", "succeeded"] and sum(r["recovered"] for r in got.values()) == 2
    assert got[3]["finished_at"] is None and got[1]["finished_at"] is not None


def test_triage(spark):
    rows = [(1, 1, "new", "a"), (1, 2, "accepted_risk", "ok"), (1, 3, "accepted_risk", "again"), (1, 4, "banana", "x"), (1, 5, "new", "back"), (2, 1, "banana", "x")]
    df = spark.createDataFrame(rows, "finding_id long, seq long, to_status string, reason string")
    audit = tr.triage_apply(df, F.col("seq"))
    assert [(r["seq"], r["from_status"], r["to_status"]) for r in audit.orderBy("seq").collect()] == [(2, "new", "accepted_risk"), (5, "accepted_risk", "new")]
    assert tr.triage_current(audit).first()["triage_reason"] == "back" and tr.triage_rejected(df).count() == 2
    early = tr.triage_current(tr.triage_apply(df.where("seq < 4"), F.col("seq"))).first()
    assert (early["status"], early["triage_reason"]) == ("accepted_risk", "ok")


def test_project_detail_is_flat_and_masked(spark):
    projects = spark.createDataFrame([(1, "a"), (2, "b")], "project_id long, name string")
    targets = spark.range(2500).selectExpr("id AS target_id", "1L AS project_id", "'t' AS name", "'pw' AS auth_password")
    rows = pj.project_detail(projects, targets).collect()
    assert len(rows) == 2501 and [r["target_id"] for r in rows if r["project_id"] == 2] == [None]
    assert {(r["name"], r["target_name"], r["auth_password"]) for r in rows if r["project_id"] == 1} == {("a", "t", "***")}


def test_project_slugs_are_compared_as_given(spark):
    projects = spark.createDataFrame([("n", "w", "My-Repo", "main")], "name string, workspace string, repo_slug string, default_branch string")
    requests = spark.createDataFrame([(1, "w", "My-Repo", "", "", ""), (2, "w", "my-repo", "", "", "")], "seq long, workspace string, repo_slug string, name string, repo_name string, default_branch string")
    got = {(r["repo_slug"], r["is_new"]) for r in pj.project_upsert(projects, requests).collect()}
    assert got == {("My-Repo", False), ("my-repo", True)}


def test_target_patch_null_and_absent_differ(spark):
    t = spark.createDataFrame([(1, "n", "u", True, "form", "pw")], "target_id long, name string, url string, is_production boolean, auth_mode string, auth_password string")
    p = spark.createDataFrame([(1, 1, {"name": "x", "url": "v", "auth_mode": "a"}), (1, 2, {"auth_mode": None, "is_production": "false"})], "target_id long, seq long, changes map<string,string>")
    assert tuple(pj.target_patch(t, p).first()) == (1, "n", "u", False, None, "***")


# ---------------------------------------------------------------- archives
def zipped(*members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body, mode in members:
            info = zipfile.ZipInfo(name)
            info.external_attr = mode << 16
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, body)
    return buf.getvalue()


def test_archives(spark):
    f = 0o100644
    given = {
        "ok": (zipped(("repo-main/app.py", "x", f), ("repo-main/README.md", "y", f)), ""), "up": (zipped(("../evil.txt", "x", f)), "archive contains a path-traversal entry"),
        "abs": (zipped(("/etc/x", "x", f)), "unsafe archive entry"), "link": (zipped(("a", "b", 0o120777)), "unsupported archive entry type"), "empty": (zipped(), "zip archive is empty"),
        "bomb": (zipped(("a", "0" * 500000, f)), "archive entry has an excessive compression ratio"), "bad": (b"nothing", "invalid zip archive"),
        "many": (zipped(*[(f"f{i}", "x", f) for i in range(6)]), "archive has too many files"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in given.items()], "archive_id string, content binary")
    members = archives.archive_manifest(df)
    got = {r["archive_id"]: r["reason"] for r in archive.archive_audit(members, max_files=5).collect()}
    assert got == {k: v[1] for k, v in given.items()}
    stripped = archive.common_root_strip(members.where("archive_id in ('ok', 'link')"))
    assert sorted(r["target"] for r in stripped.collect()) == ["README.md", "a", "app.py"]


def test_archives_go_to_python_a_few_at_a_time(spark):
    """Not in Arrow batches, which hold ten thousand archives whatever their size."""
    df = spark.createDataFrame([(str(i), zipped((f"f{i}", "x", 0o100644))) for i in range(5)], "archive_id string, content binary")
    members = archives.archive_manifest(df)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "MapInPandas" not in plan and "Arrow" not in plan
    assert members.columns == ["archive_id", "pos", "filename", "external_attr", "file_size", "compress_size", "archive_error"]
    assert sorted((r.archive_id, r.pos, r.filename, r.file_size) for r in members.collect()) == [(str(i), 0, f"f{i}", 1) for i in range(5)]


# ---------------------------------------------------------------- rules
MANIFEST = """
version: 1
sources:
  - {id: own, repository: r, license: MIT, revision: v, profile: p, path_prefixes: [python, go], expected_rule_count: 17}
  - {id: other, repository: r, license: MIT, revision: v, profile: p, path_prefixes: [vendor/o/rules], expected_rule_count: 2, hashes: {vendor/o/rules/a.yaml: "00"}}
"""
RULES = """
rules:
  - id: one
    languages: [python]
    message: m
    severity: ERROR
    metadata: {category: security, cwe: ["CWE-1"], confidence: HIGH, license: MIT, references: [u], owasp: [o], remediation: r}
    patterns:
      - pattern-either:
          - pattern: eval(...)
          - pattern: exec(...)
  - id: two
    languages: [generic]
    message: m
    severity: WARNING
    pattern-regex: 'open\\s+port'
  - message: nameless
"""


def docs(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/") + ".yaml", v.encode()) for k, v in files.items()], "path string, content binary")


def test_governance(spark):
    sources = rulepack.manifest_load(docs(spark, m=MANIFEST))
    pack = docs(spark, python__a=RULES, go__b="rules: 5", go__c=RULES.replace("two", "three"), stray=RULES, pythonic__x="rules: []")
    rules = rulepack.rule_pack_load(pack)
    got = sorted((r["check"], r["subject"]) for r in g.rule_governance(sources, rules, pack).collect())
    assert got == [("count", "other"), ("count", "own"), ("duplicate", "one"), ("file", "go/b.yaml"), ("hash", "vendor/o/rules/a.yaml"), ("owner", "pythonic/x.yaml"),
                   ("owner", "stray.yaml"), ("rule_id", "go/c.yaml"), ("rule_id", "python/a.yaml")]
    bad = rulepack.manifest_load(docs(spark, m="version: 2"))
    assert bad.first()["file_error"].startswith("manifest must")


def test_loaded_rules_scan(spark):
    rows = rulepack.rule_pack_load(docs(spark, python__a=RULES)).collect()
    assert [r["patterns"] for r in rows] == [["eval(...)", "exec(...)"], [], []] and rows[0]["cwe"] == ["CWE-1"]
    lines = rules_from_rows(rows, compile_calls=False)
    files = spark.createDataFrame([("p", "a.tf", "x\nopen   port\n")], "project string, path string, content string")
    assert [(r["line_start"], r["rule_id"], r["severity"]) for r in rule_scan(files, lines).collect()] == [(2, "two", "medium")]
    assert [r.rule_id for r in rules_from_rows(rows, compile_calls=True)] == ["one"]


def test_rule_metadata(spark):
    rules = rulepack.rule_pack_load(docs(spark, python__a=RULES))
    got = sorted((r["rule_id"], r["field"]) for r in g.rule_metadata_check(rules).collect())
    assert got == [("two", f) for f in ("confidence", "cwe", "license", "owasp", "references", "remediation")]


def test_rule_selection(spark):
    files = spark.createDataFrame([(p,) for p in ("common/z.yml", "common/a.yaml", "go/g.yaml", "python/p.yaml", "python/deep/q.yaml", "vendor/x/y/v.yml", "java/j.yaml", "common/no.txt")], "path string")
    langs = spark.createDataFrame([("p", ["python", "go"]), ("q", [])], "project string, languages array<string>")
    got = rulepack.rule_pack_select(files, langs).orderBy("project", "group_ord", "ext_ord", "path").collect()
    assert [r["path"] for r in got if r["project"] == "p"] == ["common/a.yaml", "common/z.yml", "python/p.yaml", "go/g.yaml", "vendor/x/y/v.yml"]
    assert [r["path"] for r in got if r["project"] == "q"] == ["common/a.yaml", "common/z.yml", "vendor/x/y/v.yml"]


def test_registry_refuses_wrong_output(spark):
    files = spark.createDataFrame([("p", "a", "b")], "project string, path string, content string")
    reg = detectors.DetectorRegistry()
    with pytest.raises(detectors.DetectorError) as e:
        reg.register(detectors.Detector("odd", "sast", lambda f: f), files)
    assert e.value.kind == "malformed_output"
    with pytest.raises(detectors.DetectorError):
        reg.run(files, ["missing"])


def test_rules_match_over_lines_and_at_any_depth(spark):
    files = spark.createDataFrame(
        [("p", "a.tf", 'x = 1\ncidr_blocks = [\n  "0.0.0.0/0"\n]\npassword\n'), ("p", "b.py", "eval(f(g(x)))\neval(compile(open(p).read(), p, 'exec'))\nsubprocess.run(shlex.join(list(map(str, a))),\n  shell=True)\nsubprocess.run(a, shell=False)\n"),
         ("p", "c.py", "eval(" + "(a)" * 5_000 + ")\nsubprocess.run(" + "f(a), " * 5_000 + "shell=True)\n")],
        "project string, path string, content string",
    )
    open_world = Rule("open", ("generic",), "ERROR", regexes=(r'cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"', r"password(?!\s\s)$"))
    assert sorted((r["file_path"], r["line_start"]) for r in rule_scan(files, [open_world]).collect()) == [("a.tf", 2), ("a.tf", 5)]
    calls = [Rule(c, ("python",), "ERROR", regexes=(compile_call_pattern(c),)) for c in ("eval(...)", "subprocess.run(..., shell=True, ...)")]
    got = sorted((r["file_path"], r["line_start"], r["rule_id"][:4]) for r in rule_scan_calls(files, calls).collect())
    assert got == [("b.py", 1, "eval"), ("b.py", 2, "eval"), ("b.py", 3, "subp"), ("c.py", 1, "eval"), ("c.py", 2, "subp")]


def test_rules_are_parsed_in_many_tasks_and_patterns_on_demand(spark):
    """Documents are dealt out before they are parsed; a plan that reads no patterns doesn't look for them."""
    df = spark.createDataFrame([(f"r{i}.yaml", RULES) for i in range(3)], "path string, content string")
    rules = rulepack.rule_pack_load(df)
    few, whole = (x._jdf.queryExecution().executedPlan().toString() for x in (rules.select("path", "rule_id"), rules))
    assert few.count("MapInPandas") == whole.count("MapInPandas") == 1 and "EvalPython" not in few and "EvalPython" in whole
    assert "Exchange hashpartitioning(path" in few.split("MapInPandas")[1]
    assert {tuple(r.patterns) for r in rules.where("rule_id = 'one'").collect()} == {("eval(...)", "exec(...)")}
