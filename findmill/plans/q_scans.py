"""Registered queries: scan planning and admission, projects, targets, archives."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from findmill import constants as K
from findmill.operators import archive, dedup, projects as pj, scans as sc, summary
from findmill.plans import views as v
from findmill.sources import archives, catalog, reports as rp

Q: dict = {}
_S = v.D_SCANS
_KNOWN = "list_filter(string_split(engines, ','), lambda e: e IN ('bandit', 'opengrep', 'trivy', 'gitleaks', 'zap'))"
_DEFAULT = (
    "CASE scan_type WHEN 'full' THEN ['bandit', 'opengrep', 'trivy', 'gitleaks'] WHEN 'dast' THEN ['zap'] WHEN 'sca' THEN ['trivy'] "
    "WHEN 'secrets' THEN ['gitleaks'] ELSE ['bandit', 'opengrep'] END"
)
_PLAN = (
    "SELECT *, CASE WHEN engine = 'zap' AND NOT zap_reachable THEN 'zap is not reachable (is ZAP running at the configured API URL?)' "
    "WHEN engine <> 'zap' AND NOT has_checkout THEN engine || ' requires a local checkout' WHEN engine = 'bandit' AND NOT has_python THEN 'bandit is skipped: no Python files detected' "
    "WHEN engine = 'opengrep' AND NOT has_rules THEN 'opengrep is skipped: no matching local rules for the detected languages' ELSE '' END AS reason "
    f"FROM (SELECT *, unnest(CASE WHEN engines <> '' THEN {_KNOWN} ELSE {_DEFAULT} END) AS engine FROM ({_S}))"
)


def _plan(spark, sf):
    langs = F.when(F.col("has_python"), F.array(F.lit("python"), F.lit("go"))).otherwise(F.array(F.lit("go")))
    return sc.engine_plan(v.scans(spark, sf).withColumn("languages", langs))


Q["engine_plan"] = (
    lambda s, d: _plan(s, d).select("scan_id", "engine", "state", "reason"),
    f"SELECT scan_id, engine, CASE WHEN reason = '' THEN 'running' ELSE 'skipped' END AS state, reason FROM ({_PLAN})",
)
Q["engine_dim_join"] = (
    lambda s, d: sc.engine_dim_join(_plan(s, d).select("scan_id", "engine")),
    "SELECT scan_id, engine, CASE engine WHEN 'trivy' THEN 'sca' WHEN 'gitleaks' THEN 'secrets' WHEN 'zap' THEN 'dast' ELSE 'sast' END AS source_type "
    f"FROM ({_PLAN})",
)

# Engine run log: one run per event.
_RUN = {
    "exit_code": "CASE WHEN event_id % 11 = 0 THEN cast(NULL AS int) ELSE cast(k % 10 AS int) END",
    "stderr": "CASE WHEN event_type = 'error' THEN 'Maven: server returned 429 Retry-After: ' || cast(k AS string) WHEN event_type = 'view' THEN 'bad rule' ELSE '' END",
    "timed_out": "event_id % 13 = 0",
    "retry_exit_code": "CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END",
    "retry_stderr": "concat('offline ', cast(event_id AS string))",
}
_RUN_COLS = [f"{e} AS {n}" for n, e in _RUN.items()]


def engine_run_classify(spark, sf):
    runs = v.events(spark, sf).selectExpr("event_id", "engine", *_RUN_COLS)
    return sc.engine_run_classify(runs).select("event_id", "engine", "state", "kind", "reason")


_KIND = (
    "CASE WHEN timed_out THEN 'timeout' WHEN exit_code IS NULL THEN 'unavailable' "
    "WHEN engine = 'trivy' AND exit_code <> 0 AND stderr LIKE 'Maven%' AND retry_exit_code = 0 THEN 'degraded' "
    "WHEN exit_code = 0 OR (exit_code = 1 AND engine <> 'trivy') THEN '' WHEN engine = 'opengrep' AND exit_code BETWEEN 2 AND 8 THEN 'rule_config' ELSE 'execution' END"
)
Q["engine_run_classify"] = (
    engine_run_classify,
    "SELECT event_id, engine, CASE WHEN kind IN ('', 'degraded') THEN 'done' WHEN kind = 'unavailable' THEN 'unavailable' ELSE 'failed' END AS state, kind, "
    "CASE kind WHEN '' THEN '' WHEN 'timeout' THEN engine || ' timed out' WHEN 'unavailable' THEN engine || ' executable not found' "
    f"WHEN 'degraded' THEN '{K.DEGRADED_MESSAGE} Retry-After: ' || k || '.' WHEN 'rule_config' THEN engine || ' rule/config error (exit ' || exit_code || '): ' || stderr "
    "ELSE engine || ' exited ' || exit_code || ': ' || stderr || "
    f"CASE WHEN engine = 'trivy' AND exit_code <> 0 AND stderr LIKE 'Maven%' AND retry_exit_code <> 0 THEN '{K.RETRY_FAILED_MESSAGE}' || retry_stderr ELSE '' END END AS reason "
    f"FROM (SELECT *, {_KIND} AS kind FROM (SELECT event_id, engine, k, {', '.join(_RUN_COLS)} FROM ({v.D_EVENTS})))",
)


def _requests(spark, sf):
    return v.scans(spark, sf).withColumn(
        "engines", F.when(F.col("engines") == "", F.expr("cast(array() AS array<string>)")).otherwise(F.split("engines", ","))
    ).withColumn("project_id", F.when(F.col("scan_id") % 31 == 0, F.lit(-1)).otherwise(F.col("project_id")))


_ADMIT = (
    "SELECT s.scan_id, CASE WHEN p.project_id IS NULL THEN 'project not found' "
    "WHEN p.workspace = '' AND s.ref_type IN ('branch', 'pr') THEN 'uploaded projects cannot be rescanned as branch/PR; upload a new ZIP to scan a new snapshot' "
    "WHEN s.engines LIKE '%bogus%' THEN 'unknown engines: bogus' WHEN s.scan_type <> 'dast' THEN '' WHEN s.dast_target IS NULL THEN 'dast scans require a configured target' "
    "WHEN t.target_id IS NULL THEN 'target not found for this project' WHEN t.is_production AND NOT s.dast_confirmed THEN 'target is production: you must confirm active scanning explicitly' "
    "WHEN NOT t.pre_approved AND NOT s.dast_confirmed THEN 'target is not pre-approved: confirm to run active scan' ELSE '' END AS reason "
    f"FROM (SELECT * REPLACE (CASE WHEN scan_id % 31 = 0 THEN -1 ELSE project_id END AS project_id) FROM ({_S})) s LEFT JOIN ({v.D_PROJECTS}) p ON s.project_id = p.project_id "
    f"LEFT JOIN ({v.D_TARGETS}) t ON try_cast(s.dast_target AS bigint) = t.target_id AND t.project_id = s.project_id"
)
Q["scan_admission"] = (
    lambda s, d: sc.scan_admission(_requests(s, d), v.projects(s, d), v.targets(s, d)).select("scan_id", "decision", "reason"),
    f"SELECT scan_id, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS decision, reason FROM ({_ADMIT})",
)
Q["unknown_engines"] = (
    lambda s, d: _requests(s, d).select("scan_id", F.array_join(sc.unknown_engines("engines"), ",").alias("unknown")),
    f"SELECT scan_id, CASE WHEN engines LIKE '%bogus%' THEN 'bogus' ELSE '' END AS unknown FROM ({_S})",
)
Q["scan_ref_default"] = (
    lambda s, d: sc.scan_ref_default(v.scans(s, d), v.projects(s, d)).select("scan_id", "ref_name"),
    f"SELECT scan_id, CASE WHEN ref_type = 'branch' AND ref_name = '' THEN default_branch ELSE ref_name END AS ref_name FROM ({_S}) s JOIN ({v.D_PROJECTS}) p ON s.project_id = p.project_id",
)
Q["target_lookup"] = (
    lambda s, d: sc.target_lookup(v.scans(s, d), v.targets(s, d)).select("scan_id", "target_found", F.coalesce("target_url", F.lit("")).alias("url")),
    f"SELECT scan_id, t.target_id IS NOT NULL AS target_found, coalesce(t.url, '') AS url FROM ({_S}) s LEFT JOIN ({v.D_TARGETS}) t "
    "ON try_cast(s.dast_target AS bigint) = t.target_id AND t.project_id = s.project_id",
)

_UP = {
    "preset": "CASE p_partkey % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'dependencies' WHEN 2 THEN 'custom' WHEN 3 THEN 'nope' ELSE '' END",
    "scan_type": "CASE p_partkey % 5 WHEN 0 THEN 'sast' WHEN 1 THEN 'sca' WHEN 2 THEN 'dast' WHEN 3 THEN 'secrets' ELSE 'full' END",
    "engine_csv": "CASE p_partkey % 11 WHEN 0 THEN 'bandit' WHEN 1 THEN 'bandit,zap' WHEN 2 THEN 'foo,trivy' WHEN 3 THEN 'trivy,gitleaks' ELSE '' END",
    "filename": "p_name || CASE WHEN p_partkey % 13 = 0 THEN '.tar' ELSE '.ZIP' END",
    "size_bytes": "cast(p_size AS bigint) * 2500000",
}
_UP_COLS = [f"{e} AS {n}" for n, e in _UP.items()]


def upload_admission(spark, sf):
    u = v.load(spark, sf, "part").selectExpr("p_partkey", *_UP_COLS).withColumn("engines", F.split("engine_csv", ","))
    return sc.upload_admission(u).select(
        "p_partkey", "resolved_type", F.array_join("resolved_engines", ",").alias("engines"), "decision", "reason"
    )


_COMPAT = "CASE {t} WHEN 'full' THEN 'bandit,opengrep,trivy,gitleaks' WHEN 'sast' THEN 'bandit,opengrep' WHEN 'sca' THEN 'trivy' WHEN 'secrets' THEN 'gitleaks' ELSE '' END"
_UPX = (
    "SELECT *, CASE preset WHEN 'full' THEN 'full' WHEN 'dependencies' THEN 'sca' ELSE scan_type END AS resolved_type, "
    "CASE preset WHEN 'full' THEN 'bandit,opengrep,trivy,gitleaks' WHEN 'dependencies' THEN 'trivy' ELSE engine_csv END AS asked "
    f"FROM (SELECT p_partkey, {', '.join(_UP_COLS)} FROM part)"
)
Q["upload_admission"] = (
    upload_admission,
    f"WITH u AS (SELECT *, CASE WHEN asked = '' THEN {_COMPAT.replace('{t}', 'resolved_type')} ELSE asked END AS engines, {_COMPAT.replace('{t}', 'resolved_type')} AS compat FROM ({_UPX})), "
    "m AS (SELECT *, list_filter(string_split(engines, ','), lambda e: NOT list_contains(string_split(compat, ','), e)) AS misfit FROM u), "
    "r AS (SELECT *, CASE WHEN preset = 'nope' THEN 'unknown preset: nope' WHEN preset = 'custom' AND asked = '' THEN 'custom preset requires at least one engine' "
    "WHEN resolved_type = 'dast' THEN 'scan_type must be one of full, sast, sca, secrets' WHEN engines LIKE '%foo%' THEN 'unknown engines: foo' "
    "WHEN engines LIKE '%zap%' THEN 'zap is only available for DAST scans' WHEN len(misfit) > 0 THEN 'engines not valid for scan_type: ' || array_to_string(misfit, ', ') "
    f"WHEN filename LIKE '%.tar' THEN 'please upload a .zip archive' WHEN size_bytes > {K.MAX_UPLOAD_BYTES} THEN 'upload exceeds the maximum size of {K.MAX_UPLOAD_BYTES} bytes' ELSE '' END AS reason FROM m) "
    "SELECT p_partkey, resolved_type, engines, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS decision, reason FROM r",
)


def recover_stale_scans(spark, sf):
    s = v.scans(spark, sf).withColumn("finished_at", F.lit(None).cast("timestamp"))
    out = sc.recover_stale_scans(s, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return out.select("scan_id", "status", "error", F.coalesce(F.date_format("finished_at", "yyyy-MM-dd"), F.lit("")).alias("finished"), "recovered")


Q["recover_stale_scans"] = (
    recover_stale_scans,
    "SELECT scan_id, CASE WHEN r THEN 'failed' ELSE status END AS status, CASE WHEN r THEN 'scan interrupted by service restart' ELSE '' END AS error, "
    f"CASE WHEN r THEN '2024-01-01' ELSE '' END AS finished, r AS recovered FROM (SELECT *, status IN ('pending', 'running') AS r FROM ({_S}))",
)

# ---------------------------------------------------------------- engine outcomes
_R = v.D_ENGINE_RUNS
_REAL = "('timeout', 'execution', 'malformed_output', 'rule_config')"
Q["scan_verdict"] = (
    lambda s, d: summary.scan_verdict(v.engine_runs(s, d)),
    f"SELECT scan_id, CASE WHEN NOT f AND g THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN f THEN '{K.VERDICT_ENGINE_FAILED}' WHEN NOT g THEN '{K.VERDICT_NONE_COMPLETED}' ELSE '' END AS error "
    f"FROM (SELECT scan_id, bool_or(kind IN {_REAL}) AS f, bool_or(state = 'done') AS g FROM ({_R}) GROUP BY scan_id)",
)
Q["engine_state_counts"] = (
    lambda s, d: summary.engine_state_counts(v.engine_runs(s, d), ["scan_id"]),
    "SELECT scan_id, " + ", ".join(f"count(*) FILTER (state = '{x}') AS {x}" for x in K.ENGINE_STATES) + f" FROM ({_R}) GROUP BY scan_id",
)


def coverage_rollup(spark, sf):
    runs = v.engine_runs(spark, sf)
    return summary.coverage_rollup(runs.join(summary.scan_verdict(runs).select("scan_id", F.col("status").alias("scan_status")), "scan_id")).drop("scan_status")


Q["coverage_rollup"] = (
    coverage_rollup,
    "SELECT scan_id, done, failed, total, CASE WHEN f OR done = 0 THEN 'Scan failed' WHEN failed > 0 THEN 'Scan completed with warnings' ELSE 'Scan completed' END AS headline "
    f"FROM (SELECT scan_id, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state IN ('failed', 'unavailable')) AS failed, count(*) AS total, bool_or(kind IN {_REAL}) AS f FROM ({_R}) GROUP BY scan_id)",
)


def scan_summary(spark, sf):
    """Findings per scan with the engine runs of the scan of the same number."""
    s = summary.scan_summary(v.findings(spark, sf), v.engine_runs(spark, sf))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("scan_id", "total", text("by_severity").alias("by_severity"), text("engines").alias("engines"))


def _count_text(alias: str, col: str, names) -> str:
    return "concat_ws(','" + "".join(
        f", CASE WHEN count(*) FILTER ({col} = '{n}') > 0 THEN '{n}=' || count(*) FILTER ({col} = '{n}') END" for n in names
    ) + f") AS {alias}"


Q["scan_summary"] = (
    scan_summary,
    f"WITH f AS (SELECT scan_id, count(*) AS total, {_count_text('by_severity', 'severity', K.SEVERITIES)} FROM ({v.D_FINDINGS}) GROUP BY scan_id), "
    f"e AS (SELECT scan_id, {_count_text('engines', 'state', K.ENGINE_STATES)} FROM ({_R}) GROUP BY scan_id) "
    "SELECT coalesce(f.scan_id, e.scan_id) AS scan_id, coalesce(total, 0) AS total, coalesce(by_severity, '') AS by_severity, coalesce(engines, '') AS engines FROM f FULL JOIN e ON f.scan_id = e.scan_id",
)

def scan_head_commit(spark, sf):
    """Catalog pages of pull requests, one per project; a scan asks for number project % 7, the page has project % 5."""
    body = F.format_string('{"values": [{"id": %d, "state": "MERGED", "source": {"commit": {"hash": "%s"}}}]}', F.col("project_id") % 5, F.md5("name"))
    pages = v.projects(spark, sf).select("workspace", "repo_slug", body.alias("body"))
    scans = v.scans(spark, sf).withColumn("ref_name", F.when(F.col("ref_type") == "pr", (F.col("project_id") % 7).cast("string")).otherwise(F.col("ref_name")))
    return sc.scan_head_commit(scans, v.projects(spark, sf), catalog.catalog_pull_requests(pages, "any")).select("scan_id", "ref_type", "commit_sha")


Q["scan_head_commit"] = (
    scan_head_commit,
    "SELECT scan_id, ref_type, CASE WHEN ref_type <> 'pr' THEN commit_sha WHEN p.project_id % 7 = p.project_id % 5 THEN md5(p.name) ELSE '' END AS commit_sha "
    f"FROM ({_S}) s LEFT JOIN ({v.D_PROJECTS}) p ON s.project_id = p.project_id",
)


def direct_dast(spark, sf):
    asked = v.load(spark, sf, "supplier").selectExpr(
        "s_suppkey AS scan_id", "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name", "concat('https://d', s_suppkey) AS url", "s_nationkey % 2 = 0 AS is_production",
        "s_nationkey % 3 = 0 AS pre_approved", "s_suppkey % 4 = 0 AS dast_confirmed",
    )
    made = sc.direct_dast(asked)
    slug = made["projects"].select("scan_id", F.expr("substring_index(repo_slug, '-', -1) = substr(sha2(cast(scan_id AS string), 256), 1, 6)").alias("own_project"))
    target = made["targets"].select(F.col("project_scan_id").alias("scan_id"), F.col("name").alias("target_name"), "url", "login_url")
    scans = made["scans"].select("scan_id", "engines", "ref_name", "dast_target")
    out = made["decisions"]
    for part in (slug, target, scans):
        out = out.join(part, "scan_id", "left")
    return out


Q["direct_dast"] = (
    direct_dast,
    "SELECT scan_id, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS decision, reason, CASE WHEN reason = '' THEN true END AS own_project, CASE WHEN reason = '' THEN shown END AS target_name, "
    "CASE WHEN reason = '' THEN url END AS url, CASE WHEN reason = '' THEN '' END AS login_url, CASE WHEN reason = '' THEN 'zap' END AS engines, CASE WHEN reason = '' THEN shown END AS ref_name, "
    "CASE WHEN reason = '' THEN cast(scan_id AS string) END AS dast_target FROM (SELECT s_suppkey AS scan_id, 'https://d' || s_suppkey AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'https://d' || s_suppkey ELSE s_name END AS shown, "
    "CASE WHEN s_nationkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'target is production: you must confirm active scanning explicitly' "
    "WHEN s_nationkey % 3 <> 0 AND s_suppkey % 4 <> 0 THEN 'target is not pre-approved: confirm to run active scan' ELSE '' END AS reason FROM supplier)",
)

# ---------------------------------------------------------------- the end of a scan
# Five events are the engine runs of one scan; every seventh report is broken, the others hold up to two entries.
_ENGINE_OF = "CASE event_id % 5 WHEN 0 THEN 'bandit' WHEN 1 THEN 'opengrep' WHEN 2 THEN 'trivy' WHEN 3 THEN 'gitleaks' ELSE 'zap' END"
_ENTRIES = "event_id % 3"


def _engine_reports(spark, sf):
    def body(head, entry, tail):
        return F.concat(F.lit(head), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < F.col("k"), F.concat(F.lit(entry), i.cast("string"), F.lit('"}')))), ","), F.lit(tail))

    e = v.events(spark, sf).selectExpr("event_id", "event_id div 5 AS scan_id", f"{_ENGINE_OF} AS engine", f"{_ENTRIES} AS k")
    bodies = {
        "bandit": body('{"results": [', '{"test_id": "t", "issue_severity": "HIGH", "filename": "', "]}"),
        "opengrep": body('{"results": [', '{"check_id": "c", "extra": {"severity": "ERROR"}, "path": "', "]}"),
        "trivy": body('{"SchemaVersion": 2, "ArtifactName": "a", "Results": [{"Target": "t", "Vulnerabilities": [', '{"Severity": "HIGH", "VulnerabilityID": "', "]}]}"),
        "gitleaks": body("[", '{"RuleID": "r", "File": "', "]"),
        "zap": body('{"alerts": [', '{"pluginId": "p", "risk": "3", "url": "', "]}"),
    }
    text = F.coalesce(*[F.when(F.col("engine") == n, b) for n, b in bodies.items()])
    return e.select("scan_id", F.col("event_id").alias("report_id"), "engine", F.when(F.col("event_id") % 7 == 0, "broken").otherwise(text).alias("body"))


def scan_outcome(spark, sf):
    """Runs and reports of five engines, some of which fail, to verdict, engine states and summary in the scan's row."""
    runs = v.events(spark, sf).selectExpr("event_id div 5 AS scan_id", f"{_ENGINE_OF} AS engine", *_RUN_COLS)
    parsed = rp.parse_reports(_engine_reports(spark, sf))
    states = sc.engine_states(runs, parsed)
    found = sc.completed_findings(rp.findings_of(parsed), states)
    kept = dedup.dedup_first(dedup.with_fingerprint(found), ["scan_id"], ["report_id", "ordinal"])
    scans = runs.select("scan_id").distinct().withColumns({"status": F.lit("running"), "error": F.lit("")})
    done = sc.finish_scans(scans, sc.scan_outcome(states, found, kept), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    shown = F.transform(F.map_entries("engine_statuses"), lambda e: F.concat_ws(":", e["key"], e["value"]["state"], e["value"]["findings"].cast("string"), e["value"]["kind"]))
    counts = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return done.select("scan_id", "status", "error", F.array_join(shown, ",").alias("engines"), F.col("summary.total").alias("total"), counts("summary.by_severity").alias("by_severity"), counts("summary.engines").alias("states"))


_D_RUN_STATE = (
    f"SELECT scan_id, engine, n, CASE WHEN kind IN ('', 'degraded') AND bad THEN 'malformed_output' ELSE kind END AS kind FROM (SELECT *, {_KIND} AS kind FROM "
    f"(SELECT event_id // 5 AS scan_id, {_ENGINE_OF} AS engine, {_ENTRIES} AS n, event_id % 7 = 0 AS bad, {', '.join(_RUN_COLS)} FROM ({v.D_EVENTS})))"
)
Q["scan_outcome"] = (
    scan_outcome,
    f"WITH r AS (SELECT *, CASE WHEN kind IN ('', 'degraded') THEN 'done' WHEN kind = 'unavailable' THEN 'unavailable' ELSE 'failed' END AS state FROM ({_D_RUN_STATE})), "
    f"g AS (SELECT scan_id, bool_or(kind IN {_REAL}) AS f, bool_or(state = 'done') AS d, string_agg(concat_ws(':', engine, state, CASE WHEN state = 'done' THEN n END, nullif(kind, '')), ',' ORDER BY engine) AS engines, "
    f"coalesce(sum(n) FILTER (state = 'done'), 0)::BIGINT AS total, {_count_text('states', 'state', K.ENGINE_STATES)} FROM r GROUP BY scan_id) "
    f"SELECT scan_id, CASE WHEN NOT f AND d THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN f THEN '{K.VERDICT_ENGINE_FAILED}' WHEN NOT d THEN '{K.VERDICT_NONE_COMPLETED}' ELSE '' END AS error, "
    "engines, total, CASE WHEN total > 0 THEN 'high=' || total ELSE '' END AS by_severity, states FROM g",
)

# ---------------------------------------------------------------- projects and targets
def project_upsert(spark, sf):
    """Every supplier asks for a project; a third of the names exist, slugs repeat."""
    r = v.load(spark, sf, "supplier").selectExpr(
        "s_suppkey AS seq", "CASE s_suppkey % 3 WHEN 0 THEN 'machinery' ELSE 'w' END AS workspace", "concat('Repo-', s_suppkey % 40) AS repo_slug",
        "CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name", "'' AS repo_name", "'' AS default_branch",
    )
    return pj.project_upsert(v.projects(spark, sf), r)


Q["project_upsert"] = (
    project_upsert,
    f"WITH p AS ({v.D_PROJECTS}), r AS (SELECT s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN 'machinery' ELSE 'w' END AS workspace, 'Repo-' || s_suppkey % 40 AS repo_slug, "
    "CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name FROM supplier), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY workspace, repo_slug ORDER BY seq) AS rn FROM r) "
    "SELECT name, workspace, repo_slug, default_branch, false AS is_new FROM p UNION ALL SELECT CASE WHEN name <> '' THEN name ELSE repo_slug END, workspace, repo_slug, 'main', true "
    "FROM n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM p WHERE p.workspace = n.workspace AND p.repo_slug = n.repo_slug)",
)
Q["standalone_project"] = (
    lambda s, d: pj.standalone_project(v.load(s, d, "customer").selectExpr("c_custkey AS scan_id", "CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN '***' ELSE concat(' ', c_name) END AS name")),
    "SELECT c_custkey AS scan_id, CASE c_custkey % 3 WHEN 0 THEN 'upload' WHEN 1 THEN '***' ELSE c_name END AS name, '' AS workspace, "
    "CASE c_custkey % 3 WHEN 2 THEN lower(replace(c_name, '#', '')) ELSE 'upload' END || '-' || substr(sha256(cast(c_custkey AS string)), 1, 6) AS repo_slug, 'upload' AS default_branch FROM customer",
)
Q["projects_order"] = (
    lambda s, d: pj.projects_order(v.projects(s, d)).select("project_id", "name"),
    "SELECT c_custkey AS project_id, c_name AS name FROM customer ORDER BY c_name",
)


def project_detail(spark, sf):
    return pj.project_detail(v.projects(spark, sf), v.targets(spark, sf)).select("project_id", "name", "target_id", "target_name", "auth_mode", "auth_password")


Q["project_detail"] = (
    project_detail,
    "SELECT p.project_id, p.name, t.target_id, t.name AS target_name, t.auth_mode, CASE WHEN t.auth_password = '' THEN '' WHEN t.target_id IS NOT NULL THEN '***' END AS auth_password "
    f"FROM ({v.D_PROJECTS}) p LEFT JOIN ({v.D_TARGETS}) t ON p.project_id = t.project_id",
)


def target_patch(spark, sf):
    """Nations patch the suppliers as targets; several patches may hit the same field. Name and address stay."""
    patches = v._run(
        spark, sf,
        "SELECT s_suppkey AS target_id, l_orderkey * 8 + l_linenumber AS seq, CASE l_linenumber % 3 WHEN 0 THEN map('login_url', concat('u', l_orderkey * 8 + l_linenumber), 'url', 'http://moved') "
        "WHEN 1 THEN map('auth_mode', cast(NULL AS string), 'is_production', 'true') ELSE map('auth_username', concat('n', l_orderkey * 8 + l_linenumber), 'name', 'other') END AS changes "
        "FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey WHERE s_nationkey % 2 = 0",
    )
    targets = v.targets(spark, sf).withColumns({"login_url": F.lit(""), "auth_username": F.lit("user")})
    return pj.target_patch(targets, patches).select("target_id", "name", "url", "login_url", "auth_username", "auth_password", "is_production", F.coalesce("auth_mode", F.lit("null")).alias("auth_mode"))


Q["target_patch"] = (
    target_patch,
    "WITH p AS (SELECT l_suppkey AS target_id, l_linenumber % 3 AS m, max(l_orderkey * 8 + l_linenumber) AS seq FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 2 = 0 GROUP BY ALL), "
    "w AS (SELECT target_id, max(seq) FILTER (m = 0) AS u, max(seq) FILTER (m = 1) AS a, max(seq) FILTER (m = 2) AS n FROM p GROUP BY target_id) "
    "SELECT t.target_id, t.name, t.url, CASE WHEN w.u IS NULL THEN '' ELSE 'u' || w.u END AS login_url, CASE WHEN w.n IS NULL THEN 'user' ELSE 'n' || w.n END AS auth_username, "
    "CASE WHEN t.auth_password = '' THEN '' ELSE '***' END AS auth_password, "
    "CASE WHEN w.a IS NULL THEN t.is_production ELSE true END AS is_production, CASE WHEN w.a IS NULL THEN t.auth_mode ELSE 'null' END AS auth_mode "
    f"FROM ({v.D_TARGETS}) t LEFT JOIN w ON t.target_id = w.target_id",
)


# ---------------------------------------------------------------- archives
def zip_pages(spark, sf):
    """One ZIP per page: the page itself and its address, some under odd names."""

    def pack(pid: int, url: str, html: str) -> bytes:
        if pid % 7 == 6:
            return b"no zip"
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            if pid % 7 != 5:
                for name, body in ((f"site{pid}/index.html", html), ("../up.txt" if pid % 7 == 4 else f"site{pid}/url.txt", url)):
                    info = zipfile.ZipInfo(name)
                    info.external_attr = (0o120777 if pid % 7 == 3 else 0o100644) << 16
                    z.writestr(info, body.encode("utf-8"))
        return buf.getvalue()

    content = F.udf(pack, "binary", useArrow=False)("page_id", "url", "html")
    return v.load(spark, sf, "pages").select(F.col("page_id").cast("string").alias("archive_id"), content.alias("content"))


_M = "SELECT cast(page_id AS string) AS archive_id, page_id % 7 AS m, {0} FROM pages"
Q["archive_manifest"] = (
    lambda s, d: archives.archive_manifest(zip_pages(s, d)).select(
        "archive_id", "pos", F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("file_size", F.lit(0)).alias("file_size"), F.coalesce("archive_error", F.lit("")).alias("archive_error")
    ),
    "SELECT cast(page_id AS string) AS archive_id, 0 AS pos, 'site' || page_id || '/index.html' AS filename, octet_length(encode(html)) AS file_size, '' AS archive_error FROM pages WHERE page_id % 7 < 5 "
    "UNION ALL SELECT cast(page_id AS string), 1, CASE WHEN page_id % 7 = 4 THEN '../up.txt' ELSE 'site' || page_id || '/url.txt' END, octet_length(encode(url)), '' FROM pages WHERE page_id % 7 < 5 "
    "UNION ALL SELECT cast(page_id AS string), -1, '', 0, CASE WHEN page_id % 7 = 6 THEN 'invalid zip archive' ELSE '' END FROM pages WHERE page_id % 7 >= 5",
)
_BIG = 20000
Q["archive_audit"] = (
    lambda s, d: archive.archive_audit(archives.archive_manifest(zip_pages(s, d)), max_file_bytes=_BIG),
    "SELECT archive_id, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS decision, reason FROM (SELECT cast(page_id AS string) AS archive_id, CASE page_id % 7 WHEN 6 THEN 'invalid zip archive' "
    "WHEN 5 THEN 'zip archive is empty' WHEN 4 THEN 'archive contains a path-traversal entry' WHEN 3 THEN 'unsupported archive entry type' "
    f"ELSE CASE WHEN octet_length(encode(html)) > {_BIG} THEN 'file too large' ELSE '' END END AS reason FROM pages)",
)
Q["archive_totals"] = (
    lambda s, d: archive.archive_totals(archives.archive_manifest(zip_pages(s, d))).select("archive_id", "files", "bytes"),
    "SELECT cast(page_id AS string) AS archive_id, CASE WHEN page_id % 7 = 3 THEN 0 ELSE 2 END AS files, CASE WHEN page_id % 7 = 3 THEN 0 ELSE octet_length(encode(html)) + octet_length(encode(url)) END AS bytes "
    "FROM pages WHERE page_id % 7 < 5",
)
_HOST = "regexp_extract(url, '^[a-z]+://([^/]*)', 1)"
_NAME = "CASE WHEN page_id % 5 = 0 THEN 'zz/' ELSE '' END || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '')"
Q["common_root_strip"] = (
    lambda s, d: archive.common_root_strip(v.load(s, d, "pages").selectExpr("page_id", f"{_HOST} AS archive_id", f"{_NAME} AS filename")).select("page_id", "archive_id", "filename", "target"),
    "WITH m AS (SELECT page_id, archive_id, filename, filename <> '' AND filename NOT LIKE '%/' AS f FROM "
    f"(SELECT page_id, {_HOST} AS archive_id, {_NAME} AS filename FROM pages)), "
    "a AS (SELECT archive_id, count(DISTINCT string_split(filename, '/')[1]) FILTER (f) = 1 AND bool_and(filename LIKE '%/%') FILTER (f) AS strip, any_value(string_split(filename, '/')[1]) FILTER (f) AS root FROM m GROUP BY archive_id) "
    "SELECT page_id, m.archive_id, filename, CASE WHEN coalesce(strip, false) THEN substr(filename, length(root) + 2) ELSE filename END AS target FROM m JOIN a ON m.archive_id = a.archive_id",
)
