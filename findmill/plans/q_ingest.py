"""Registered queries over detector reports, catalogs and diffs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill.functions.text import let
from findmill.operators import diff
from findmill.plans import views as v
from findmill.sources import catalog, reports

Q: dict = {}
_OUT = ["report_id", "ordinal", "tool", "source_type", "rule_id", "severity", "cwe", "file_path", "line_start", "line_end", "snippet", "description", "remediation"]


def _named(**cols):
    return F.struct(*[c.alias(k) for k, c in cols.items()])


def _base(spark, sf, tables=None):
    return v.raw_findings(spark, sf, tables)


def _of(engine, body):
    def reports_of(spark, sf, tables=None):
        return _base(spark, sf, tables).select(F.col("finding_id").alias("report_id"), F.lit(engine).alias("engine"), body().alias("body"))

    return reports_of


def _bandit_body():
    """One report per finding with two results; the second leaves most fields out."""
    code = F.concat(F.lit("3 x = 1\n4    y = "), F.col("pk").cast("string"), F.lit("\n>>> z\n"))
    full = _named(
        test_id=F.col("rule_id"), issue_severity=F.col("raw_severity"), issue_confidence=F.lit("HIGH"),
        issue_cwe=_named(id=(F.col("pk") % 30).cast("int")), filename=F.col("raw_path"), line_number=F.col("line_start"),
        col_offset=F.lit(1), end_col_offset=F.lit(9), code=code, issue_text=F.col("description"), more_info=F.col("remediation"),
    )
    short = full.dropFields("issue_severity", "issue_cwe", "code", "more_info", "line_number")
    r = F.concat(F.lit('{"results": ['), F.to_json(full), F.lit(", "), F.to_json(short), F.lit("]}"))
    return r


def _opengrep_body():
    meta = F.concat(
        F.lit('{"cwe": '),
        F.when(F.col("pk") % 3 == 0, '"79"').when(F.col("pk") % 3 == 1, '["CWE-89: sql", "x"]').otherwise('{"id": "22"}'),
        F.when(F.col("pk") % 2 == 0, ', "category": "security"').otherwise(""),
        F.lit(', "severity": "note", "references": ["https://a"]}'),
    )
    sev = F.when(F.col("pk") % 4 == 0, F.col("raw_severity")).when(F.col("pk") % 4 == 1, "INFO").otherwise("")
    body = F.concat(
        F.lit('{"results": [{"check_id": "home.rules.'), F.col("rule_id"), F.lit('", "path": "'), F.col("raw_path"),
        F.lit('", "start": {"line": '), F.col("ordinal").cast("string"), F.lit(', "col": 1}, "end": {"line": '), (F.col("ordinal") + 1).cast("string"),
        F.lit(', "col": 5}, "extra": {"severity": "'), sev, F.lit('", "message": "m", "lines": "'),
        F.when(F.col("pk") % 2 == 0, "requires login").otherwise("one\\ntwo"), F.lit('", "fix": "f", "metadata": '), meta, F.lit("}}]}"),
    )
    return body


def _trivy_body():
    vuln = _named(
        VulnerabilityID=F.col("rule_id"), PkgName=F.lit("lib"), InstalledVersion=F.col("ordinal").cast("string"),
        FixedVersion=F.when(F.col("pk") % 2 == 0, "9").otherwise(""), Severity=F.col("raw_severity"), Description=F.col("description"),
        References=F.when(F.col("pk") % 3 == 0, F.array("remediation")), CweIDs=F.when(F.col("cwe") != "", F.array("cwe")),
    )
    body = F.concat(
        F.lit('{"SchemaVersion": 2, "ArtifactName": "a", "Results": [{"Target": "none"}, {"Target": "'), F.col("raw_path"),
        F.lit('", "Vulnerabilities": ['), F.to_json(vuln), F.lit(", "), F.to_json(vuln), F.lit("]}]}"),
    )
    return body


def _gitleaks_body():
    secret = F.concat(F.lit("tok"), F.col("pk").cast("string"))
    leak = _named(
        RuleID=F.col("rule_id"), File=F.col("raw_path"), StartLine=F.col("ordinal"), EndLine=F.col("ordinal") + 1,
        Secret=F.when(F.col("pk") % 5 == 0, "").otherwise(secret), Match=F.concat(F.lit("key is "), secret, F.lit(";")), Description=F.col("description"),
    )
    body = F.concat(F.lit("["), F.to_json(leak), F.lit("]"))
    return body


def _zap_body():
    alert = _named(
        pluginId=F.when(F.col("pk") % 2 == 0, F.col("rule_id")), alertRef=F.lit("ref"),
        risk=F.when(F.col("pk") % 6 == 5, "High").otherwise((F.col("pk") % 6).cast("string")), cweid=F.when(F.col("pk") % 3 == 0, "79"),
        url=F.concat(F.lit("https://h/"), F.col("scan_id").cast("string")), param=F.when(F.col("pk") % 2 == 0, "q"),
        alert=F.when(F.col("pk") % 4 != 0, "alert"), description=F.col("description"), solution=F.col("remediation"),
    )
    body = F.concat(F.lit('{"alerts": ['), F.to_json(alert), F.lit("]}"))
    return body


_BODIES = {"bandit": _bandit_body, "opengrep": _opengrep_body, "trivy": _trivy_body, "gitleaks": _gitleaks_body, "zap": _zap_body}
bandit_reports, opengrep_reports, trivy_reports, gitleaks_reports, zap_reports = (_of(e, b) for e, b in _BODIES.items())

_B = v.duck(v.FINDINGS)


def _cols(**e) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in e.items())


_SEV = v.severity_sql("raw_severity")
_D_BANDIT = (
    "SELECT "
    + _cols(
        report_id="finding_id", ordinal="n", tool="'bandit'", source_type="'sast'", rule_id="rule_id",
        severity=f"CASE WHEN n = 0 THEN {_SEV} ELSE 'low' END",
        cwe="CASE WHEN n = 0 AND pk % 30 <> 0 THEN 'CWE-' || cast(pk % 30 AS string) ELSE '' END", file_path="raw_path",
        line_start="CASE WHEN n = 0 THEN line_start END", line_end="CASE WHEN n = 0 THEN line_start END",
        snippet="CASE WHEN n = 0 THEN 'y = ' || cast(pk AS string) || chr(10) || '>>> z' ELSE '' END",
        description="description", remediation="CASE WHEN n = 0 THEN remediation ELSE '' END",
    )
    + f" FROM ({_B}) CROSS JOIN (SELECT unnest([0, 1]) AS n)"
)
_OG_SEV = (
    f"CASE WHEN pk % 4 = 0 AND raw_severity <> '' THEN {_SEV} ELSE 'info' END"
)
_D_OPENGREP = (
    "SELECT "
    + _cols(
        report_id="finding_id", ordinal="0", tool="'opengrep'", source_type="'sast'", rule_id="rule_id",
        severity=f"CASE WHEN {_OG_SEV} = 'info' AND pk % 2 = 0 THEN 'medium' ELSE {_OG_SEV} END",
        cwe="CASE pk % 3 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89: SQL' ELSE 'CWE-22' END", file_path="raw_path",
        line_start="ordinal", line_end="ordinal + 1", snippet="CASE WHEN pk % 2 = 1 THEN 'one' || chr(10) || 'two' END",
        description="'m'", remediation="'f'",
    )
    + f" FROM ({_B})"
)
_D_TRIVY = (
    "SELECT "
    + _cols(
        report_id="finding_id", ordinal="2147483648 + n", tool="'trivy'", source_type="'sca'", rule_id="rule_id", severity=_SEV, cwe="cwe",
        file_path="raw_path", line_start="cast(NULL AS int)", line_end="cast(NULL AS int)", snippet="''", description="description",
        remediation="'Upgrade lib from ' || cast(ordinal AS string) || CASE WHEN pk % 2 = 0 THEN ' to 9' ELSE '' END || CASE WHEN pk % 3 = 0 THEN '. See: ' || remediation ELSE '' END",
    )
    + f" FROM ({_B}) CROSS JOIN (SELECT unnest([0, 1]) AS n)"
)
_D_GITLEAKS = (
    "SELECT "
    + _cols(
        report_id="finding_id", ordinal="0", tool="'gitleaks'", source_type="'secrets'", rule_id="rule_id", severity="'high'", cwe="''",
        file_path="raw_path", line_start="ordinal", line_end="ordinal + 1",
        snippet="CASE WHEN pk % 5 = 0 THEN 'key is tok' || cast(pk AS string) || ';' ELSE 'key is [REDACTED];' END", description="description",
        remediation="'Rotate the leaked secret and remove it from source. Use CI/CD secrets or a vault.'",
    )
    + f" FROM ({_B})"
)
_URL = "'https://h/' || cast(scan_id AS string)"
_D_ZAP = (
    "SELECT "
    + _cols(
        report_id="finding_id", ordinal="0", tool="'zap'", source_type="'dast'", rule_id="CASE WHEN pk % 2 = 0 THEN rule_id ELSE 'ref' END",
        severity="CASE pk % 6 WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'info' END",
        cwe="CASE WHEN pk % 3 = 0 THEN 'CWE-79' ELSE '' END", file_path=_URL, line_start="cast(NULL AS int)", line_end="cast(NULL AS int)",
        snippet=f"{_URL} || CASE WHEN pk % 2 = 0 THEN ' (param: q)' ELSE '' END",
        description="CASE WHEN pk % 4 <> 0 THEN 'alert' ELSE description END", remediation="remediation",
    )
    + f" FROM ({_B})"
)
Q["ingest_bandit"] = (lambda s, d: reports.ingest_bandit(bandit_reports(s, d)).select(_OUT), _D_BANDIT)
Q["ingest_opengrep"] = (lambda s, d: reports.ingest_opengrep(opengrep_reports(s, d)).select(_OUT), _D_OPENGREP)
Q["ingest_trivy"] = (lambda s, d: reports.ingest_trivy(trivy_reports(s, d)).select(_OUT), _D_TRIVY)
Q["ingest_gitleaks"] = (lambda s, d: reports.ingest_gitleaks(gitleaks_reports(s, d)).select(_OUT), _D_GITLEAKS)
Q["ingest_zap_alerts"] = (lambda s, d: reports.ingest_zap_alerts(zap_reports(s, d)).select(_OUT), _D_ZAP)


def mixed_reports(spark, sf, tables=None):
    """Every engine's report for the findings of that engine; some bodies are broken."""
    base = _base(spark, sf, tables).withColumn("report_id", F.col("finding_id"))
    which = F.pmod(F.col("report_id"), F.lit(5))
    engine, body = F.lit(None), F.lit(None)
    for i, (name, make) in enumerate(_BODIES.items()):
        engine, body = F.when(which == i, name).otherwise(engine), F.when(which == i, make()).otherwise(body)
    out = base.select("report_id", engine.cast("string").alias("engine"), body.cast("string").alias("body"))
    bad = F.pmod(F.floor(F.col("report_id") / 5), F.lit(9))
    # within let, the bodies are not compiled into one method with the join, which would be too long for the JVM's compiler
    broken = let(bad, lambda b: F.when(b == 0, "not-json").when(b == 1, "{}").when(b == 2, "[]").when(b == 3, "null"))
    return out.withColumn("body", F.coalesce(broken, F.col("body")))


Q["ingest_report_envelope"] = (
    lambda s, d: reports.ingest_report_envelope(mixed_reports(s, d)).select(
        "report_id", "engine", F.coalesce("kind", F.lit("ok")).alias("kind"), F.coalesce("reason", F.lit("")).alias("reason")
    ),
    "SELECT report_id, engine, CASE WHEN reason = '' THEN 'ok' ELSE 'malformed_output' END AS kind, reason FROM (SELECT report_id, engine, "
    "CASE WHEN bad = 0 THEN 'invalid JSON' WHEN bad > 3 OR (engine = 'gitleaks' AND bad = 2) OR (engine = 'zap' AND bad = 1) THEN '' WHEN engine IN ('bandit', 'opengrep') THEN 'missing a results array' "
    "WHEN engine = 'gitleaks' THEN 'report must be a JSON array' WHEN engine = 'trivy' THEN 'missing required report metadata' ELSE 'report must be a JSON object' END AS reason "
    "FROM (SELECT finding_id AS report_id, CASE finding_id % 5 WHEN 0 THEN 'bandit' WHEN 1 THEN 'opengrep' WHEN 2 THEN 'trivy' WHEN 3 THEN 'gitleaks' ELSE 'zap' END AS engine, "
    f"(finding_id // 5) % 9 AS bad FROM ({_B})))",
)
_GOOD = "(report_id // 5) % 9 > 3"
Q["union_engines"] = (
    lambda s, d: reports.ingest_all(mixed_reports(s, d)).select(_OUT),
    " UNION ALL ".join(
        f"SELECT * FROM ({q}) WHERE report_id % 5 = {i} AND {_GOOD}" for i, q in enumerate((_D_BANDIT, _D_OPENGREP, _D_TRIVY, _D_GITLEAKS, _D_ZAP))
    ),
)

# ---------------------------------------------------------------- catalog
_PAGE = (
    "concat('{\"values\": [{\"slug\": \"', c_name, '\", \"name\": \"n\", \"language\": \"python\", \"project\": {\"key\": \"', c_mktsegment, '\"}, \"description\": \"', repeat('d', 190 + cast(c_custkey % 20 AS int)), '\"}], "
    "\"next\": \"https://api.example/2.0/repositories/w?cursor=', c_custkey, '&x=1\"}')"
)
_STATE = "CASE c_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'MERGED' WHEN 2 THEN 'OPEN' ELSE 'DECLINED' END"
_PR = (
    f"concat('{{\"values\": [{{\"id\": ', c_custkey, ', \"title\": \"t\", \"state\": \"', {_STATE}, '\", \"source\": {{\"branch\": {{\"name\": \"s\"}}}}, \"destination\": {{\"branch\": {{\"name\": \"main\"}}}}, "
    "\"author\": {\"display_name\": \"', c_name, '\"}, \"links\": {\"html\": {\"href\": \"https://x\"}}}]}')"
)
_BR = "concat('{\"values\": [{\"name\": \"b', c_custkey, '\", \"target\": {\"hash\": \"', md5(c_name), '\", \"message\": \"', repeat('m', 95 + cast(c_custkey % 10 AS int)), '\"}}, {\"name\": \"empty\"}]}')"


def ingest_scm_catalog(spark, sf):
    """Repositories, branches and open pull requests of all pages as one (kind, key, text) table."""
    c = v.load(spark, sf, "customer")
    repos = catalog.catalog_repos(c.selectExpr("c_custkey AS page", f"{_PAGE} AS body"))
    branches = catalog.catalog_branches(c.selectExpr("c_custkey AS page", f"{_BR} AS body"))
    prs = catalog.catalog_pull_requests(c.selectExpr("c_custkey AS page", f"{_PR} AS body"))
    return (
        repos.select("page", F.lit("repo").alias("kind"), F.concat_ws("|", "slug", "name", "language", "project", "description").alias("text"))
        .unionByName(branches.select("page", F.lit("branch").alias("kind"), F.concat_ws("|", "name", "hash", "message").alias("text")))
        .unionByName(
            prs.select("page", F.lit("pr").alias("kind"), F.concat_ws("|", F.col("id").cast("string"), "title", "state", "source", "destination", "author", "link").alias("text"))
        )
    )


Q["ingest_scm_catalog"] = (
    ingest_scm_catalog,
    "SELECT c_custkey AS page, 'repo' AS kind, c_name || '|n|python|' || c_mktsegment || '|' || repeat('d', least(200, 190 + c_custkey % 20)) AS text FROM customer "
    "UNION ALL SELECT c_custkey, 'branch', 'b' || c_custkey || '|' || md5(c_name) || '|' || repeat('m', least(100, 95 + c_custkey % 10)) FROM customer "
    "UNION ALL SELECT c_custkey, 'branch', 'empty||' FROM customer "
    f"UNION ALL SELECT c_custkey, 'pr', c_custkey || '|t|' || {_STATE} || '|s|main|' || c_name || '|https://x' FROM customer WHERE c_custkey % 2 = 0",
)


def page_cursor(spark, sf):
    c = v.load(spark, sf, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('https://api.example/2.0/repositories/w?x=1&cursor=', c_custkey) "
        "WHEN 2 THEN concat('https://api.example/2.0/r?pagelen=5&cursor=', c_custkey) ELSE 'https://other.example/3.0/r' END AS next",
    )
    cur = c.withColumn("cursor", catalog.page_cursor("next", "https://api.example/2.0"))
    return cur.select("c_custkey", F.coalesce("cursor", F.lit("none")).alias("cursor"), F.coalesce(catalog.replay_params("cursor"), F.lit("none")).alias("params"))


Q["page_cursor"] = (
    page_cursor,
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN '/repositories/w?x=1&cursor=' || c_custkey WHEN 2 THEN '/r?pagelen=5&cursor=' || c_custkey ELSE '/3.0/r' END AS cursor, "
    "CASE c_custkey % 4 WHEN 0 THEN 'pagelen=100' WHEN 1 THEN 'cursor=' || c_custkey || '&x=1&pagelen=100' WHEN 2 THEN 'cursor=' || c_custkey || '&pagelen=5' ELSE 'pagelen=100' END AS params FROM customer",
)

# ---------------------------------------------------------------- diffs
Q["diff_parse"] = (
    lambda s, d: diff.diff_parse(v.diffs(s, d), ["scan_id"]),
    'SELECT o_orderkey AS scan_id, \'src/p0.py\' AS path, 1 + o_orderkey % 3 AS "start", 1 + o_orderkey % 3 + 1 AS "end" FROM orders WHERE o_custkey % 3 > 0 '
    'UNION ALL SELECT o_orderkey, \'src/p0.py\', 1 + o_orderkey % 3, 3 + o_orderkey % 3 FROM orders WHERE o_custkey % 3 = 0 '
    'UNION ALL SELECT o_orderkey, \'src/p0.py\', 3 + o_orderkey % 3 + o_custkey % 3, 3 + o_orderkey % 3 + o_custkey % 3 FROM orders WHERE o_custkey % 3 > 0 '
    "UNION ALL SELECT o_orderkey, 'p1.py', 2, 3 FROM orders",
)
_RANGES = "l_orderkey % 100 AS grp, l_partkey * 3 + l_linenumber AS s, l_partkey * 3 + l_linenumber + cast(l_quantity AS int) % 4 AS e"


def interval_coalesce(spark, sf):
    r = v.load(spark, sf, "lineitem").selectExpr("l_orderkey % 100 AS grp", "l_partkey * 3 + l_linenumber AS start", "l_partkey * 3 + l_linenumber + cast(l_quantity AS int) % 4 AS end")
    return diff.interval_coalesce(r, ["grp"], chunk_lines=1024)


Q["interval_coalesce"] = (
    interval_coalesce,
    f"WITH r AS (SELECT {_RANGES} FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r), "
    "i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m) "
    'SELECT grp, min(s) AS "start", max(e) AS "end" FROM i GROUP BY grp, isl',
)


def diff_interval_match(spark, sf):
    f = v.findings(spark, sf).drop("in_pr_diff")
    return diff.diff_interval_match(f, diff.diff_parse(v.diffs(spark, sf), ["scan_id"]), coalesced=True).select("finding_id", "in_pr_diff")


D_PR_MATCH = (
    "source_type = 'sast' AND line_start IS NOT NULL AND ((file_path = 'src/p0.py' AND (line_start BETWEEN 1 + scan_id % 3 AND 2 + scan_id % 3 OR line_start = 3 + scan_id % 3 + project_id % 3)) "
    "OR (file_path = 'src/p1.py' AND line_start BETWEEN 2 AND 3))"
)
Q["diff_interval_match"] = (
    diff_interval_match,
    f"SELECT finding_id, {D_PR_MATCH} AS in_pr_diff FROM (SELECT * EXCLUDE (in_pr_diff) FROM ({v.D_FINDINGS}))",
)
