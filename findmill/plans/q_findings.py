"""Registered queries: findings, their expressions, reads, summaries, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions import findings as fx
from findmill.functions import text as tx
from findmill.functions.sql import register_sql_functions
from findmill.operators import dedup, findings as op, report, summary
from findmill.plans import views as v

Q: dict = {}


def _deduped(spark, sf):
    return dedup.dedup_first(v.fingerprinted(spark, sf), ["scan_id"], ["ordinal", "finding_id"])


# ---------------------------------------------------------------- flagship
def severity_summary(spark, sf):
    return summary.severity_summary(_deduped(spark, sf))


def _summary_sql(src: str, keys: str = "") -> str:
    arms = " UNION ALL ".join(
        [
            f"SELECT {keys}{i} AS ordinal, '{s.capitalize()}' AS label, count(*) FILTER (severity = '{s}') AS n FROM d "
            + (f"GROUP BY {keys.rstrip(', ')}" if keys else "")
            for i, s in enumerate(K.SEVERITIES)
        ]
        + [f"SELECT {keys}5 AS ordinal, 'Total' AS label, count(*) AS n FROM d " + (f"GROUP BY {keys.rstrip(', ')}" if keys else "")]
    )
    return f"WITH d AS ({src}) {arms}"


Q["severity_summary"] = (severity_summary, _summary_sql(v.D_DEDUPED))

# ---------------------------------------------------------------- expressions
Q["sev_normalize"] = (
    lambda s, d: v.raw_findings(s, d).select("finding_id", fx.sev_normalize("raw_severity").alias("severity")),
    f"SELECT finding_id, {v.severity_sql('raw_severity')} AS severity FROM ({v.duck(v.FINDINGS)})",
)
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
Q["sev_rank"] = (
    lambda s, d: v.findings(s, d).select("finding_id", fx.sev_rank("severity").alias("rank")),
    f"SELECT finding_id, {_RANK} AS rank FROM ({v.D_FINDINGS})",
)
Q["sev_display"] = (
    lambda s, d: v.raw_findings(s, d).select("finding_id", fx.sev_display(F.lower(F.col("raw_severity"))).alias("shown")),
    "SELECT finding_id, CASE WHEN lower(raw_severity) IN ('critical','high','medium','low','info') THEN lower(raw_severity) "
    f"ELSE 'info' END AS shown FROM ({v.duck(v.FINDINGS)})",
)
_PAGE_PATH = "CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 1 THEN '/srv/' || regexp_replace(url, '^[a-z]+://', '') || '/../x' ELSE './' || regexp_replace(url, '^[a-z]+://[^/]*/', '../') END"
Q["path_relativize"] = (
    lambda s, d: v._run(s, d, f"SELECT page_id, {_PAGE_PATH} AS p FROM {{pages}}").select(
        "page_id", fx.path_relativize("p", "/srv").alias("path")
    ),
    f"SELECT page_id, {v.relativize_sql('p', chr(39) + '/srv' + chr(39))} AS path FROM (SELECT page_id, {_PAGE_PATH} AS p FROM pages)",
)
Q["path_contained"] = (
    lambda s, d: v.raw_findings(s, d).where(fx.path_contained("raw_path", F.col("root"))).select("finding_id", "raw_path"),
    f"SELECT finding_id, raw_path FROM ({v.D_FINDINGS}) WHERE file_path <> ''",
)
Q["fingerprint"] = (
    lambda s, d: v.fingerprinted(s, d).select("finding_id", "fingerprint"),
    f"SELECT finding_id, fingerprint FROM ({v.D_FINGERPRINTED})",
)


def _redact_sql(c: str) -> str:
    for rx in K.CREDENTIAL_PATTERNS.values():
        c = "regexp_replace(" + c + ", '" + rx.replace("'", "''") + f"', '{K.REDACTED}', 'g')"
    return c


def redact(spark, sf):
    """Whole texts of three corpora; documents and turns get a word of their own as exact token."""
    docs = v.load(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("sub"), "text")
    pages = v.load(spark, sf, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.lit(0).cast("long").alias("sub"), F.col("html").alias("text"))
    conv = v.load(spark, sf, "conversations").select(F.lit("conversations").alias("src"), F.col("conv_id").alias("id"), F.col("turn").alias("sub"), "text")
    token = F.array(F.substring_index("text", " ", 1))
    return docs.unionByName(pages).unionByName(conv).select(
        "src", "id", "sub", F.sha2(tx.redact("text", token), 256).alias("redacted_sha")
    )


_TOK = "CASE WHEN length(string_split(text, ' ')[1]) >= 4 THEN replace(text, string_split(text, ' ')[1], '[REDACTED]') ELSE text END"
Q["redact"] = (
    redact,
    f"SELECT src, id, sub, sha256({_redact_sql(_TOK)}) AS redacted_sha FROM ("
    "SELECT 'documents' AS src, doc_id AS id, 0 AS sub, text FROM documents UNION ALL SELECT 'pages', page_id, 0, html FROM pages "
    "UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations)",
)
Q["redact_match"] = (
    lambda s, d: v.findings(s, d).select("finding_id", tx.redact_match("snippet", F.regexp_extract("snippet", "= ([a-z0-9]+)", 1)).alias("masked")),
    "SELECT finding_id, CASE WHEN regexp_extract(snippet, '= ([a-z0-9]+)', 1) <> '' THEN replace(snippet, regexp_extract(snippet, '= ([a-z0-9]+)', 1), '[REDACTED]') "
    f"ELSE snippet END AS masked FROM ({v.D_FINDINGS})",
)
_CRED_URL = "'clone https://x-token-auth' || ':' || cast(c_custkey * 31 AS string) || '@host/' || c_name || ' by ' || cast(c_custkey AS string)"
Q["redact_url_creds"] = (
    lambda s, d: v._run(s, d, f"SELECT c_custkey, {_CRED_URL} AS t FROM {{customer}}").select(
        "c_custkey", tx.redact_url_creds("t", F.concat(F.lit("by "), F.col("c_custkey").cast("string"))).alias("safe")
    ),
    "SELECT c_custkey, regexp_replace(replace(t, 'by ' || cast(c_custkey AS string), '[REDACTED]'), 'x-token-auth:[^@\\s]+@', '[REDACTED]@', 'g') AS safe "
    f"FROM (SELECT c_custkey, {_CRED_URL} AS t FROM customer)",
)
Q["sanitize_reason"] = (
    lambda s, d: v.raw_findings(s, d).select(
        "finding_id", tx.sanitize_reason(F.concat(F.lit("cannot open "), "raw_path"), F.col("root")).alias("reason")
    ),
    f"SELECT finding_id, replace('cannot open ' || raw_path, root, '<workdir>') AS reason FROM ({v.duck(v.FINDINGS)})",
)
Q["mask_credentials"] = (
    lambda s, d: v.targets(s, d).select("target_id", tx.mask_credentials("auth_password").alias("auth_password")),
    f"SELECT target_id, CASE WHEN auth_password <> '' THEN '***' ELSE '' END AS auth_password FROM ({v.D_TARGETS})",
)
_INT_TEXT = "CASE event_id % 4 WHEN 0 THEN ' ' || cast(k AS string) || ' ' WHEN 1 THEN cast(k AS string) || 'x' WHEN 2 THEN '-' || cast(k AS string) ELSE event_type END"
Q["first_int"] = (
    lambda s, d: v.events(s, d).selectExpr("event_id", f"{_INT_TEXT} AS t").select("event_id", tx.first_int("t").alias("n")),
    f"SELECT event_id, try_cast(trim({_INT_TEXT}) AS bigint) AS n FROM ({v.D_EVENTS})",
)
_BOOL_TEXT = "CASE event_id % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN '  ' WHEN 3 THEN 'ON' WHEN 4 THEN 'off' WHEN 5 THEN '1' ELSE event_type END"
Q["parse_bool_strict"] = (
    lambda s, d: v.events(s, d)
    .selectExpr("event_id", f"{_BOOL_TEXT} AS t")
    .withColumn("b", tx.parse_bool("t"))
    .select("event_id", F.coalesce(F.col("b.value").cast("string"), F.lit("error")).alias("value"), F.coalesce("b.error", F.lit("")).alias("error")),
    "SELECT event_id, CASE WHEN w IN ('1','true','yes','on') THEN 'true' WHEN w IN ('','0','false','no','off') THEN 'false' ELSE 'error' END AS value, "
    "CASE WHEN w IN ('1','true','yes','on','','0','false','no','off') THEN '' ELSE 'invalid boolean value: ' || t END AS error "
    f"FROM (SELECT event_id, t, lower(trim(t)) AS w FROM (SELECT event_id, {_BOOL_TEXT} AS t FROM ({v.D_EVENTS})))",
)
Q["slugify"] = (
    lambda s, d: v.load(s, d, "customer").select("c_custkey", tx.slugify("c_name").alias("slug")),
    "SELECT c_custkey, lower(regexp_replace(c_name, '[^a-zA-Z0-9._-]', '', 'g')) AS slug FROM customer",
)
Q["markup_escape"] = (
    lambda s, d: v.load(s, d, "pages").select(
        "page_id", F.sha2(tx.markup_escape("html"), 256).alias("text_sha"), F.sha2(tx.markup_escape("html", quotes=True), 256).alias("attr_sha")
    ),
    "SELECT page_id, sha256(e) AS text_sha, sha256(replace(replace(e, '\"', '&quot;'), chr(39), '&#39;')) AS attr_sha "
    "FROM (SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM pages)",
)
Q["finding_header"] = (
    lambda s, d: v.findings(s, d).select("finding_id", fx.finding_header("severity", "tool", "rule_id", "cwe").alias("header")),
    "SELECT finding_id, upper(severity) || ' | ' || tool || ' | ' || rule_id || CASE WHEN cwe <> '' THEN ' | ' || cwe ELSE '' END AS header "
    f"FROM ({v.D_FINDINGS})",
)
_LOC = "CASE WHEN file_path = '' THEN '-' ELSE file_path END || CASE WHEN line_start IS NULL OR line_start = 0 THEN '' ELSE ':' || cast(line_start AS string) END"
Q["finding_location"] = (
    lambda s, d: v.findings(s, d).select("finding_id", fx.finding_location("file_path", "line_start").alias("location")),
    f"SELECT finding_id, {_LOC} AS location FROM ({v.D_FINDINGS})",
)
Q["human_size"] = (
    lambda s, d: v.load(s, d, "documents").select("doc_id", tx.human_size(F.col("n_chars") * (F.col("doc_id") % 500 + 1)).alias("size")),
    "SELECT doc_id, CASE WHEN n < 1024 THEN cast(n AS string) || ' B' "
    "WHEN n < 1048576 THEN cast((n * 10 + 512) // 1024 // 10 AS string) || '.' || cast((n * 10 + 512) // 1024 % 10 AS string) || ' KB' "
    "ELSE cast((n * 10 + 524288) // 1048576 // 10 AS string) || '.' || cast((n * 10 + 524288) // 1048576 % 10 AS string) || ' MB' END AS size FROM (SELECT doc_id, n_chars * (doc_id % 500 + 1) AS n FROM documents)",
)
Q["is_commit_sha"] = (
    lambda s, d: v.scans(s, d).select("scan_id", tx.is_commit_sha("commit_sha").alias("is_sha")),
    f"SELECT scan_id, regexp_full_match(commit_sha, '[0-9a-f]{{40}}') AS is_sha FROM ({v.D_SCANS})",
)
Q["format_timestamp"] = (
    lambda s, d: v.load(s, d, "orders").select("o_orderkey", tx.format_timestamp("o_orderdate").alias("shown")),
    "SELECT o_orderkey, coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M UTC'), '-') AS shown FROM orders",
)
_STDERR = (
    "CASE event_id % 4 WHEN 0 THEN 'Maven central returned 429; retry-after: ' || cast(k AS string) WHEN 1 THEN 'maven 429 Too Many Requests' "
    "WHEN 2 THEN 'npm returned 429 Retry-After:' || cast(k AS string) ELSE 'boom' END"
)
Q["retry_after"] = (
    lambda s, d: v.events(s, d).selectExpr("event_id", f"{_STDERR} AS t").select("event_id", tx.retry_after("t").alias("seconds")),
    f"SELECT event_id, CASE WHEN event_id % 4 IN (0, 2) THEN cast(k AS string) ELSE '' END AS seconds FROM ({v.D_EVENTS})",
)
Q["is_rate_limited"] = (
    lambda s, d: v.events(s, d).selectExpr("event_id", f"{_STDERR} AS t").select("event_id", tx.is_rate_limited("t").alias("limited")),
    f"SELECT event_id, event_id % 4 IN (0, 1) AS limited FROM ({v.D_EVENTS})",
)
Q["sse_format"] = (
    lambda s, d: v.events(s, d).select("event_id", tx.sse_format("event_type", F.to_json(F.struct("k", "state"))).alias("frame")),
    "SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {\"k\":' || cast(k AS string) || ',\"state\":\"' || state || '\"}' || chr(10) || chr(10) AS frame "
    f"FROM ({v.D_EVENTS})",
)
_RID = "CASE WHEN l_suppkey % 2 = 0 THEN 'home.user.scp.python.' || cast(l_partkey AS string) ELSE 'x.' || cast(l_partkey AS string) END"
Q["rule_id_clean"] = (
    lambda s, d: v._run(s, d, f"SELECT l_orderkey, l_linenumber, l_partkey, {_RID} AS r FROM {{lineitem}}").select(
        "l_orderkey", "l_linenumber", "l_partkey", fx.rule_id_clean("r").alias("rule_id")
    ),
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'scp.python.' || cast(l_partkey AS string) ELSE 'x.' || cast(l_partkey AS string) END AS rule_id FROM lineitem",
)
_CWE_JSON = (
    "CASE l_partkey % 6 WHEN 0 THEN '\"' || cast(l_partkey AS string) || '\"' WHEN 1 THEN '[\"cwe-' || cast(l_partkey AS string) || ': x\", \"CWE-1\"]' "
    "WHEN 2 THEN '{\"id\": \"' || cast(l_partkey AS string) || '\"}' WHEN 3 THEN 'null' WHEN 4 THEN '[]' ELSE '{\"name\": \"cwe-7 \"}' END"
)
Q["cwe_normalize"] = (
    lambda s, d: v.load(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{_CWE_JSON} AS j").select(
        "l_orderkey", "l_linenumber", "l_partkey", fx.cwe_normalize(F.parse_json("j")).alias("cwe")
    ),
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 'CWE-' || cast(l_partkey AS string) WHEN 1 THEN 'CWE-' || cast(l_partkey AS string) || ': X' "
    "WHEN 2 THEN 'CWE-' || cast(l_partkey AS string) WHEN 5 THEN 'CWE-7' ELSE '' END AS cwe FROM lineitem",
)
_MARKED = (
    "'1 def f():' || chr(10) || '22    x = ' || cast(l_partkey AS string) || chr(10) || '>>> y = ' || cast(l_suppkey AS string) || chr(10) || "
    "'3  two' || chr(10) || '    ' || CASE WHEN l_partkey % 2 = 0 THEN 'end' ELSE '' END"
)
Q["snippet_marked_lines"] = (
    lambda s, d: v._run(s, d, f"SELECT l_orderkey, l_linenumber, l_partkey, {_MARKED} AS c FROM {{lineitem}}").select(
        "l_orderkey", "l_linenumber", "l_partkey", fx.snippet_marked_lines("c").alias("snippet")
    ),
    "SELECT l_orderkey, l_linenumber, l_partkey, 'x = ' || cast(l_partkey AS string) || chr(10) || '>>> y = ' || cast(l_suppkey AS string) || chr(10) || "
    "CASE WHEN l_partkey % 2 = 0 THEN 'end' ELSE '' END AS snippet FROM lineitem",
)
Q["trivy_remediation"] = (
    lambda s, d: v.load(s, d, "part").select(
        "p_partkey",
        fx.trivy_remediation(
            F.col("p_name"), F.col("p_size").cast("string"),
            F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(""),
            F.when(F.col("p_partkey") % 3 == 0, F.array("p_type")).otherwise(F.expr("cast(array() AS array<string>)")),
        ).alias("remediation"),
    ),
    "SELECT p_partkey, 'Upgrade ' || p_name || ' from ' || cast(p_size AS string) || CASE WHEN p_partkey % 2 = 0 THEN ' to ' || p_brand ELSE '' END "
    "|| CASE WHEN p_partkey % 3 = 0 THEN '. See: ' || p_type ELSE '' END AS remediation FROM part",
)
_MODE = "CASE p_partkey % 6 WHEN 0 THEN 33188 WHEN 1 THEN 41471 WHEN 2 THEN 16877 WHEN 3 THEN 8612 WHEN 4 THEN 0 ELSE 33188 END"
_MEMBER = "p_name || CASE WHEN p_partkey % 6 = 5 THEN '/' ELSE '' END"
Q["member_type"] = (
    lambda s, d: v._run(s, d, f"SELECT p_partkey, {_MEMBER} AS f, cast({_MODE} AS bigint) * 65536 AS a FROM {{part}}").select(
        "p_partkey", fx.member_type("f", "a").alias("type")
    ),
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'symlink' WHEN 2 THEN 'dir' WHEN 3 THEN 'special' WHEN 4 THEN 'file' ELSE 'dir' END AS type FROM part",
)


def sql_functions(spark, sf):
    session = spark.newSession()
    register_sql_functions(session)
    raw = v.raw_findings(session, sf)
    return session.sql(
        "SELECT finding_id, sev_normalize(raw_severity) AS severity, path_relativize(raw_path, root) AS file_path, "
        "fingerprint(tool, rule_id, path_relativize(raw_path, root), line_start, snippet) AS fingerprint, "
        "redact(snippet, array(rule_id)) AS snippet, cwe_normalize(parse_json(concat('[\"', cwe, '\"]'))) AS cwe FROM {raw}",
        raw=raw,
    )


Q["sql_functions"] = (
    sql_functions,
    f"SELECT finding_id, severity, file_path, fingerprint, {_redact_sql('replace(snippet, rule_id, ' + chr(39) + '[REDACTED]' + chr(39) + ')')} AS snippet, cwe FROM ({v.D_FINGERPRINTED})",
)

# ---------------------------------------------------------------- dedup
Q["dedup_first"] = (
    lambda s, d: _deduped(s, d).select("finding_id", "scan_id", "fingerprint"),
    f"SELECT finding_id, scan_id, fingerprint FROM ({v.D_DEDUPED})",
)


def dedup_first_rule_scope(spark, sf):
    """Coarse identity: few fingerprints with thousands of copies each."""
    df = v.findings(spark, sf).withColumn("fingerprint", tx.fingerprint("tool", "rule_id", F.lit(""), F.lit(None), F.lit("")))
    return dedup.dedup_first(df, ["source_type"], ["scan_id", "ordinal", "finding_id"]).select("finding_id", "tool", "rule_id", "fingerprint")


Q["dedup_first_rule_scope"] = (
    dedup_first_rule_scope,
    "SELECT finding_id, tool, rule_id, sha256(tool || '|' || rule_id || '||N/A|') AS fingerprint FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY tool, rule_id ORDER BY scan_id, ordinal, finding_id) AS rn FROM ({v.duck(v.FINDINGS)})) WHERE rn = 1",
)

# ---------------------------------------------------------------- reads
_F_COLS = "finding_id, scan_id, project_id, severity, tool, file_path, status"


def findings_query(spark, sf):
    return op.findings_query(v.findings(spark, sf), status="new", source_type="sast", pr_changed=False, q="p_.PY").select(*_F_COLS.split(", "))


Q["findings_query"] = (
    findings_query,
    f"SELECT {_F_COLS} FROM ({v.D_FINDINGS}) WHERE status = 'new' AND source_type = 'sast' AND NOT in_pr_diff AND "
    "(description ILIKE '%p_.PY%' OR rule_id ILIKE '%p_.PY%' OR file_path ILIKE '%p_.PY%') ORDER BY severity, finding_id DESC LIMIT 500",
)
Q["findings_order"] = (
    lambda s, d: op.findings_order(v.findings(s, d), 5000).select("finding_id", "severity"),
    f"SELECT finding_id, severity FROM ({v.D_FINDINGS}) ORDER BY severity, finding_id DESC LIMIT 5000",
)
Q["findings_by_risk"] = (
    lambda s, d: op.findings_by_risk(v.findings(s, d)).select("finding_id", "severity"),
    f"SELECT finding_id, severity FROM ({v.D_FINDINGS}) ORDER BY {_RANK}, finding_id DESC LIMIT 500",
)
Q["text_search"] = (
    lambda s, d: op.text_search(v.load(s, d, "documents"), "THE_or%and", ("text", "source")).select("doc_id"),
    "SELECT doc_id FROM documents WHERE text ILIKE '%THE_or%and%' OR source ILIKE '%THE_or%and%'",
)
Q["scans_query"] = (
    lambda s, d: op.scans_query(v.scans(s, d), status="running").select("scan_id", "project_id", "status"),
    f"SELECT scan_id, project_id, status FROM ({v.D_SCANS}) WHERE status = 'running'",
)
Q["finding_detail"] = (
    lambda s, d: op.finding_detail(v.findings(s, d).withColumn("evidence", F.format_string('{"version": 1, "start": {"line": %d}}', "scan_id")), v.findings(s, d)).select(
        "finding_id", "severity", "file_path", "snippet", F.expr("variant_get(evidence, '$.start.line', 'long')").alias("line")
    ),
    f"SELECT finding_id, severity, file_path, snippet, scan_id AS line FROM ({v.D_FINDINGS})",
)
Q["scan_detail"] = (
    lambda s, d: op.detail(v.scans(s, d), "scan_id", 77).select("scan_id", "project_id", "scan_type", "status"),
    f"SELECT scan_id, project_id, scan_type, status FROM ({v.D_SCANS}) WHERE scan_id = 77",
)
Q["pr_only_filter"] = (
    lambda s, d: op.pr_only_filter(v.findings(s, d)).select("finding_id"),
    f"SELECT finding_id FROM ({v.duck(v.FINDINGS)}) WHERE in_pr_diff",
)
Q["finding_enrich"] = (
    lambda s, d: op.finding_enrich(v.findings(s, d).select("finding_id", "scan_id", "project_id"), v.scans(s, d), v.projects(s, d)).select(
        "finding_id", "scan_status", "scan_type", "project_name", "workspace", "repo_slug"
    ),
    f"SELECT finding_id, s.status AS scan_status, s.scan_type, p.name AS project_name, p.workspace, p.repo_slug FROM ({v.duck(v.FINDINGS)}) f "
    f"JOIN ({v.D_SCANS}) s ON f.scan_id = s.scan_id JOIN ({v.D_PROJECTS}) p ON f.project_id = p.project_id",
)
Q["live_scan_guard"] = (
    lambda s, d: op.live_scan_guard(v.findings(s, d), v.scans(s, d).where("status <> 'pending'")).select("finding_id", "scan_id"),
    f"SELECT finding_id, scan_id FROM ({v.duck(v.FINDINGS)}) WHERE scan_id IN (SELECT scan_id FROM ({v.D_SCANS}) WHERE status <> 'pending')",
)
Q["missing_entity"] = (
    lambda s, d: op.missing_entity(v.targets(s, d).withColumn("project_id", F.col("project_id") * 17), v.projects(s, d), "project_id", "project_id"),
    f"SELECT DISTINCT project_id * 17 AS project_id FROM ({v.D_TARGETS}) WHERE project_id * 17 NOT IN (SELECT c_custkey FROM customer)",
)

# ---------------------------------------------------------------- aggregates
Q["severity_counts"] = (
    lambda s, d: summary.severity_counts(_deduped(s, d), ["scan_id"]),
    f"SELECT scan_id, severity, count(*) AS n FROM ({v.D_DEDUPED}) GROUP BY ALL",
)
Q["severity_summary_by_project"] = (
    lambda s, d: summary.severity_summary(v.findings(s, d), ["project_id"]),
    _summary_sql(v.D_FINDINGS, "project_id, "),
)

def severity_summary_by_scan(spark, sf):
    """Also of scans without findings: every scan has a second one, of the negative number, that found nothing."""
    scans = v.scans(spark, sf).select("scan_id")
    return summary.severity_summary(v.findings(spark, sf), ["scan_id"], scans.unionByName(scans.select((-F.col("scan_id")).alias("scan_id"))))


Q["severity_summary_by_scan"] = (
    severity_summary_by_scan,
    f"WITH s AS (SELECT DISTINCT unnest([scan_id, -scan_id]) AS scan_id FROM ({v.D_SCANS})), d AS (SELECT s.scan_id, f.severity, f.scan_id AS has FROM s LEFT JOIN ({v.D_FINDINGS}) f ON s.scan_id = f.scan_id) "
    + " UNION ALL ".join(f"SELECT scan_id, {i} AS ordinal, '{x.capitalize()}' AS label, count(*) FILTER (severity = '{x}') AS n FROM d GROUP BY scan_id" for i, x in enumerate(K.SEVERITIES))
    + " UNION ALL SELECT scan_id, 5, 'Total', count(has) FROM d GROUP BY scan_id",
)
Q["target_counts"] = (
    lambda s, d: summary.counts_per(v.targets(s, d), ["project_id"], "targets"),
    f"SELECT project_id, count(*) AS targets FROM ({v.D_TARGETS}) GROUP BY project_id",
)

# ---------------------------------------------------------------- reports
Q["report_sections"] = (
    lambda s, d: report.report_sections(v.findings(s, d)).select("finding_id", "section", "section_ord"),
    "SELECT finding_id, CASE WHEN NOT a THEN 'Findings' WHEN in_pr_diff THEN 'Findings in Your Changed Code (this PR)' ELSE 'Pre-existing Findings in This Repository' END AS section, "
    "CASE WHEN a AND NOT in_pr_diff THEN 1 ELSE 0 END AS section_ord FROM (SELECT *, bool_or(in_pr_diff) OVER (PARTITION BY scan_id) AS a "
    f"FROM ({v.duck(v.FINDINGS)}))",
)


def _esc_sql(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


Q["report_blocks"] = (
    lambda s, d: report.report_blocks(v.findings(s, d), pr_only=True).drop("scan_id", "section", "section_ord"),
    "SELECT finding_id, upper(severity) || ' | ' || tool || ' | ' || rule_id || CASE WHEN cwe <> '' THEN ' | ' || cwe ELSE '' END AS header, "
    f"'Location: ' || {_LOC} AS location, {_esc_sql('description')} AS description, substr(snippet, 1, 1200) AS snippet, "
    f"'<b>Remediation:</b> ' || remediation AS remediation FROM ({v.D_FINDINGS}) WHERE in_pr_diff",
)
_META = {
    "Project": "p.name", "Repository": "p.workspace || '/' || p.repo_slug", "Scan type": "upper(scan_type)",
    "Scope": "ref_type || ': ' || ref_name", "Commit": "CASE WHEN commit_sha = '' THEN '-' ELSE commit_sha END",
    "Engines": "CASE WHEN engines = '' THEN 'auto' ELSE engines END", "Run date": "strftime(created_at, '%Y-%m-%d %H:%M UTC')", "Status": "status",
}
Q["report_meta"] = (
    lambda s, d: report.report_meta(v.scans(s, d), v.projects(s, d)),
    f"WITH j AS (SELECT * FROM ({v.D_SCANS}) s JOIN ({v.D_PROJECTS}) p ON s.project_id = p.project_id) "
    + " UNION ALL ".join(
        f"SELECT scan_id, {i} AS ordinal, '{k}' AS label, replace(replace(replace({e.replace('p.', '')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS value FROM j" for i, (k, e) in enumerate(_META.items())
    ),
)


def project_report(spark, sf):
    """Header, counts and sections of the report of every project."""
    f = v.findings(spark, sf).join(v.projects(spark, sf).select("project_id"), "project_id", "left_semi")
    tables = report.project_report(f, v.projects(spark, sf), F.lit("2024-06-01 10:20:30").cast("timestamp"))
    counts = tables["report_summary"].select("project_id", (F.col("ordinal") + 10).alias("ordinal"), "label", F.col("n").cast("string").alias("value"))
    blocks = tables["report_blocks"].groupBy("project_id", "section_ord", "section").agg(F.count(F.lit(1)).cast("string").alias("value"))
    blocks = blocks.select("project_id", (F.col("section_ord") + 20).alias("ordinal"), F.col("section").alias("label"), "value")
    return tables["report_meta"].unionByName(counts).unionByName(blocks)


_P_META = {"Project": "name", "Repository": "workspace || '/' || repo_slug", "Scope": "'All findings'", "Generated": "'2024-06-01 10:20 UTC'"}
Q["project_report"] = (
    project_report,
    f"WITH p AS ({v.D_PROJECTS}), f AS (SELECT * FROM ({v.D_FINDINGS}) WHERE project_id IN (SELECT project_id FROM p)), a AS (SELECT project_id, bool_or(in_pr_diff) AS any_pr FROM f GROUP BY project_id), "
    "d AS (SELECT p.project_id, f.severity, f.project_id AS has FROM p LEFT JOIN f ON p.project_id = f.project_id) "
    + " UNION ALL ".join(f"SELECT project_id, {i} AS ordinal, '{k}' AS label, {e} AS value FROM p" for i, (k, e) in enumerate(_P_META.items()))
    + "".join(f" UNION ALL SELECT project_id, {10 + i}, '{x.capitalize()}', cast(count(*) FILTER (severity = '{x}') AS string) FROM d GROUP BY project_id" for i, x in enumerate(K.SEVERITIES))
    + " UNION ALL SELECT project_id, 15, 'Total', cast(count(has) AS string) FROM d GROUP BY project_id"
    f" UNION ALL SELECT f.project_id, CASE WHEN any_pr AND NOT in_pr_diff THEN 21 ELSE 20 END, CASE WHEN NOT any_pr THEN '{report.SECTION_ALL}' WHEN in_pr_diff THEN '{report.SECTION_CHANGED}' ELSE '{report.SECTION_EXISTING}' END, "
    "cast(count(*) AS string) FROM f JOIN a ON f.project_id = a.project_id GROUP BY ALL",
)
