"""The test tables seen as findings, scans, projects, events, sources, reports.

Each view is one SQL text that Spark and the checking engine both understand, so a query
and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.functions.findings import path_relativize, sev_normalize
from findmill.operators.dedup import with_fingerprint

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FINDINGS = """
SELECT ((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 8 + l_linenumber AS finding_id,
       l_orderkey AS scan_id, o_custkey AS project_id, l_linenumber AS ordinal, l_partkey AS pk,
       CASE l_suppkey % 4 WHEN 0 THEN 'bandit' WHEN 1 THEN 'opengrep' WHEN 2 THEN 'trivy' ELSE 'gitleaks' END AS tool,
       CASE l_suppkey % 4 WHEN 2 THEN 'sca' WHEN 3 THEN 'secrets' ELSE 'sast' END AS source_type,
       'scp.rule.' || cast(l_partkey % 5 AS string) AS rule_id,
       CASE WHEN l_partkey % 7 = 0 THEN 'CRITICAL' WHEN l_partkey % 7 = 1 THEN ' Note '
            WHEN l_partkey % 7 = 2 THEN '' ELSE substr(o_orderpriority, 3) END AS raw_severity,
       CASE WHEN l_partkey % 11 = 0 THEN 'CWE-' || cast(70 + l_partkey % 30 AS string) ELSE '' END AS cwe,
       CASE WHEN l_partkey % 97 = 0 THEN '../outside.py'
            WHEN l_suppkey % 3 = 0 THEN '/work/s' || cast(l_orderkey AS string) || '/src/p' || cast(l_partkey % 3 AS string) || '.py'
            WHEN l_suppkey % 3 = 1 THEN 'src/./x/../p' || cast(l_partkey % 3 AS string) || '.py'
            ELSE 'src/p' || cast(l_partkey % 3 AS string) || '.py' END AS raw_path,
       '/work/s' || cast(l_orderkey AS string) AS root,
       CASE WHEN l_suppkey % 4 <> 2 THEN l_linenumber END AS line_start,
       CASE WHEN l_suppkey % 4 <> 2 THEN l_linenumber + cast(l_quantity AS int) % 5 END AS line_end,
       CASE WHEN l_partkey % 13 = 0 THEN 'password' || ' = value' || cast(l_partkey % 3 AS string) || 'longer'
            ELSE '  call(' || cast(cast(l_quantity AS int) % 2 AS string) || ')  ' END AS snippet,
       'Finding <b>' || cast(l_partkey AS string) || '</b> & more' AS description,
       CASE WHEN l_partkey % 2 = 0 THEN 'https://fix.example/' || cast(l_partkey % 10 AS string) ELSE 'Review the call' END AS remediation,
       CASE l_returnflag WHEN 'A' THEN 'new' WHEN 'N' THEN 'triaged' ELSE 'fixed' END AS status,
       l_linestatus = 'O' AS in_pr_diff, l_shipdate AS first_seen
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

SCANS = """
SELECT o_orderkey AS scan_id, o_custkey AS project_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'dast' WHEN 2 THEN 'sca' WHEN 3 THEN 'secrets' ELSE 'sast' END AS scan_type,
       CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'bandit,bogus' WHEN 2 THEN 'trivy' WHEN 3 THEN ''
            WHEN 4 THEN 'zap' WHEN 5 THEN 'bandit,opengrep' ELSE 'gitleaks,trivy' END AS engines,
       CASE o_orderkey % 3 WHEN 0 THEN 'branch' WHEN 1 THEN 'pr' ELSE 'upload' END AS ref_type,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'feature-' || cast(o_orderkey % 10 AS string) END AS ref_name,
       CASE WHEN o_orderkey % 2 = 0 THEN md5(cast(o_orderkey AS string)) || '00000000' ELSE '' END AS commit_sha,
       CASE WHEN o_orderkey % 10 = 1 THEN cast(o_custkey % 1000 AS string) WHEN o_orderkey % 10 = 6 AND o_orderkey % 3 = 0
            THEN cast(o_custkey AS string) END AS dast_target,
       cast(floor(o_totalprice) AS bigint) % 2 = 0 AS dast_confirmed,
       CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'succeeded' END AS status,
       '' AS error, o_orderdate AS created_at,
       o_orderkey % 9 <> 0 AS has_checkout, o_orderkey % 8 <> 0 AS has_rules, o_orderkey % 6 = 0 AS zap_reachable,
       o_orderkey % 4 < 2 AS has_python
FROM {orders}
"""

PROJECTS = """
SELECT c_custkey AS project_id, c_name AS name,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE lower(c_mktsegment) END AS workspace,
       'repo-' || cast(c_custkey AS string) AS repo_slug,
       CASE WHEN c_custkey % 3 = 0 THEN 'develop' ELSE 'main' END AS default_branch
FROM {customer}
"""

TARGETS = """
SELECT s_suppkey AS target_id, s_suppkey - s_suppkey % 3 AS project_id, s_name AS name,
       'https://t' || cast(s_suppkey AS string) || '.example' AS url,
       s_nationkey % 2 = 0 AS is_production, s_nationkey % 3 = 0 AS pre_approved,
       CASE WHEN s_suppkey % 2 = 0 THEN 'form' ELSE 'none' END AS auth_mode,
       CASE WHEN s_suppkey % 2 = 0 THEN 'u' || cast(s_suppkey AS string) ELSE '' END AS auth_username,
       CASE WHEN s_suppkey % 2 = 0 THEN 'w' || cast(s_suppkey * 7 AS string) ELSE '' END AS auth_password
FROM {supplier}
"""

EVENTS = """
SELECT event_id, user_id AS scan_id, ts, event_type, props,
       cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k,
       CASE event_id % 5 WHEN 0 THEN 'bandit' WHEN 1 THEN 'opengrep' WHEN 2 THEN 'trivy' WHEN 3 THEN 'gitleaks' ELSE 'zap' END AS engine,
       CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' WHEN 'error' THEN 'failed'
            WHEN 'purchase' THEN 'unavailable' ELSE 'skipped' END AS state,
       CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'malformed_output' ELSE '' END
            WHEN event_type = 'purchase' THEN 'unavailable' ELSE '' END AS kind,
       CASE WHEN event_id % 17 = 0 THEN 'n/a' WHEN regexp_extract(props, '([0-9]+)', 1) = '99' THEN '100'
            ELSE regexp_extract(props, '([0-9]+)', 1) END AS status
FROM {events}
"""

TRIAGE = """
SELECT user_id AS finding_id, event_id AS seq,
       CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'triaged' WHEN 'purchase' THEN 'fixed'
            WHEN 'signup' THEN 'false_positive' ELSE 'banana' END AS to_status,
       'reason ' || regexp_extract(props, '([0-9]+)', 1) AS reason, ts AS created_at
FROM {events}
"""

FILES = """
SELECT doc_id, source AS project,
       CASE WHEN doc_id % 50 = 0 THEN '.cache/' ELSE '' END || 'd' || cast(doc_id % 7 AS string) || '/f' || cast(doc_id AS string) ||
       CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.TF' ELSE '.vue' END AS path,
       text AS content
FROM {documents}
"""

# Two findings per document, on different lines; every fourth has no end line.
DOC_FINDINGS = """
SELECT doc_id * 2 + n AS finding_id, project, path AS file_path,
       cast(1 + (doc_id * (n + 1)) % 23 AS int) AS line_start,
       CASE WHEN doc_id % 4 <> 3 THEN cast(1 + (doc_id * (n + 1)) % 23 + doc_id % 4 AS int) END AS line_end,
       CASE WHEN doc_id % 3 = 0 THEN 'given line' END AS snippet,
       'sast' AS source_type, 'scp.rule.' || cast(doc_id % 5 AS string) AS rule_id
FROM (SELECT *, 0 AS n FROM ({files_sql}) UNION ALL SELECT *, 1 AS n FROM ({files_sql}))
"""

DIFFS = """
SELECT o_orderkey AS scan_id,
       'diff --git a/src/p0.py b/src/p0.py' || chr(10) || '--- a/src/p0.py' || chr(10) || '+++ b/src/p0.py' || chr(10) ||
       '@@ -1,3 +' || cast(1 + o_orderkey % 3 AS string) || ',9 @@ def f' || chr(10) ||
       ' keep' || chr(10) || '+added' || chr(10) || '-removed' || chr(10) ||
       '@@ -9 +' || cast(1 + o_orderkey % 3 + 2 + o_custkey % 3 AS string) || ' @@' || chr(10) || '+more' || chr(10) ||
       chr(92) || ' No newline at end of file' || chr(10) ||
       'diff --git a/p1.py b/p1.py' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/p1.py' || chr(10) ||
       '@@ -0,0 +2,2 @@' || chr(10) || '+one' || chr(10) || '+two' || chr(10) AS diff_text
FROM {orders}
"""

RULE_FILES = """
SELECT p_partkey AS pk,
       CASE p_partkey % 5 WHEN 0 THEN 'common/r' WHEN 1 THEN 'python/r' WHEN 2 THEN 'vendor/x/rules/r' WHEN 3 THEN 'go/r' ELSE 'stray/r' END
       || cast(p_partkey AS string) || CASE WHEN p_partkey % 2 = 0 THEN '.yaml' ELSE '.yml' END AS path,
       CASE WHEN p_partkey % 41 = 0 THEN 'rules: nothing' || chr(10)
            WHEN p_partkey % 43 = 0 THEN 'rules: [unclosed' || chr(10)
            ELSE 'rules:' || chr(10) ||
       CASE WHEN p_partkey % 37 = 0 THEN '  - message: no id' || chr(10) ELSE
       '  - id: scp.' || cast(p_partkey % 1900 AS string) || chr(10) || '    languages: [python, go]' || chr(10) ||
       '    message: ' || p_name || chr(10) || '    severity: ERROR' || chr(10) || '    metadata:' || chr(10) ||
       '      category: security' || chr(10) || '      cwe: ["CWE-' || cast(p_size AS string) || '"]' || chr(10) ||
       CASE WHEN p_partkey % 3 = 0 THEN '      license: MIT' || chr(10) ELSE '' END ||
       '      confidence: ' || CASE WHEN p_partkey % 4 = 0 THEN 'HIGH' ELSE 'LOW' END || chr(10) ||
       '    pattern-regex: ' || chr(39) || 'x' || cast(p_size AS string) || chr(39) || chr(10) END END AS content
FROM {part}
"""

# One manifest document per region: one of a wrong version, one with a repeated source, one incomplete.
MANIFESTS = """
SELECT r_regionkey AS rk,
       'version: ' || CASE WHEN r_regionkey = 3 THEN '2' ELSE '1' END || chr(10) || 'sources:' || chr(10) ||
       '  - id: src' || cast(r_regionkey AS string) || chr(10) || '    repository: local' || chr(10) || '    license: MIT' || chr(10) ||
       '    revision: r1' || chr(10) || '    profile: ' || lower(r_name) || chr(10) ||
       '    path_prefixes: [' || CASE r_regionkey WHEN 0 THEN 'common, python' WHEN 1 THEN 'go/' WHEN 2 THEN 'vendor/x' ELSE 'python' END || ']' || chr(10) ||
       '    expected_rule_count: ' || CASE WHEN r_regionkey = 1 THEN '0' ELSE '10' END || chr(10) ||
       CASE WHEN r_regionkey = 0 THEN '    hashes:' || chr(10) || '      common/r0.yaml: ' || sha2_hex || chr(10) ||
            '      common/r10.yaml: ' || sha2_hex || chr(10) || '      common/none.yaml: ' || sha2_hex || chr(10) ELSE '' END ||
       CASE WHEN r_regionkey = 4 THEN '  - id: src4' || chr(10) || '    repository: local' || chr(10) ELSE '' END ||
       CASE WHEN r_regionkey = 2 THEN '  - id: src2' || chr(10) || '    repository: local' || chr(10) || '    license: MIT' || chr(10) ||
            '    revision: r2' || chr(10) || '    profile: p' || chr(10) || '    path_prefixes: [vendor/x, stray]' || chr(10) ||
            '    expected_rule_count: 7' || chr(10) ELSE '' END AS content
FROM (SELECT *, {sha256} AS sha2_hex FROM {region})
"""


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _run(spark: SparkSession, sf: str, sql: str, tables: dict[str, DataFrame] | None = None, **text: str) -> DataFrame:
    """``tables`` replaces stored tables, for example by streams over them."""
    for k, v in text.items():
        sql = sql.replace("{" + k + "}", v)
    used = [t for t in TABLES if "{" + t + "}" in sql]
    given = tables or {}
    return spark.sql(sql, **{t: given[t] if t in given else load(spark, sf, t) for t in used})


def duck(sql: str, **text: str) -> str:
    """The same view as text for the checking engine."""
    for k, v in text.items():
        sql = sql.replace("{" + k + "}", v)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


#: Lines a task joins and ranks at most, on average: its sorts are held at once, whatever the size of the table.
TASK_ROWS = 1 << 19


def _dealt(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Large tables by the key they are joined on, in as many partitions as their rows ask for. Rows are counted from the files' footers."""
    lines = load(spark, sf, "lineitem")
    n = lines.count() // TASK_ROWS
    if n <= spark.sparkContext.defaultParallelism:
        return {}
    return {"lineitem": lines.repartition(n, "l_orderkey"), "orders": load(spark, sf, "orders").repartition(n, "o_orderkey")}


def raw_findings(spark: SparkSession, sf: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    return _run(spark, sf, FINDINGS, _dealt(spark, sf) if tables is None else tables)


def findings(spark: SparkSession, sf: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Findings with normalised severity and relative path, not yet deduplicated."""
    return (
        raw_findings(spark, sf, tables)
        .withColumn("severity", sev_normalize("raw_severity"))
        .withColumn("file_path", path_relativize("raw_path", F.col("root")))
        .drop("raw_severity", "raw_path", "root")
    )


def fingerprinted(spark: SparkSession, sf: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    return with_fingerprint(findings(spark, sf, tables))


def scans(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, SCANS)


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, PROJECTS)


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, TARGETS)


def events(spark: SparkSession, sf: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    return _run(spark, sf, EVENTS, tables)


def triage(spark: SparkSession, sf: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    return _run(spark, sf, TRIAGE, tables)


def files(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, FILES)


def doc_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, DOC_FINDINGS.replace("{files_sql}", FILES))


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, DIFFS)


def rule_files(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, RULE_FILES)


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, MANIFESTS, sha256="sha2(concat('rules: nothing', chr(10)), 256)")


def engine_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Latest state per scan and engine."""
    top = F.max(F.struct("event_id", "state", "kind")).alias("t")
    return events(spark, sf).groupBy("scan_id", "engine").agg(top).select("scan_id", "engine", "t.state", "t.kind")


# ---- the same derived views for the checking engine

SEVERITY_SQL = """CASE lower(trim({c})) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'error' THEN 'high'
 WHEN 'medium' THEN 'medium' WHEN 'moderate' THEN 'medium' WHEN 'warning' THEN 'medium' WHEN 'info' THEN 'info'
 WHEN 'informational' THEN 'info' WHEN 'note' THEN 'info' WHEN 'unknown' THEN 'info' ELSE 'low' END"""


def severity_sql(c: str) -> str:
    return SEVERITY_SQL.replace("{c}", c)


def relativize_sql(p: str, root: str) -> str:
    full = f"CASE WHEN {p} LIKE '/%' THEN {p} ELSE {root} || '/' || {p} END"
    folded = (
        f"list_reduce(list_prepend('', string_split({full}, '/')), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc "
        "WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END)"
    )
    return (
        f"CASE WHEN {p} = '' THEN '' WHEN {folded} = {root} THEN '.' WHEN starts_with({folded}, {root} || '/') "
        f"THEN substr({folded}, length({root}) + 2) ELSE '' END"
    )


FINGERPRINT_SQL = (
    "sha256(tool || '|' || rule_id || '|' || file_path || '|' || coalesce(cast(line_start AS string), 'N/A') "
    "|| '|' || substr(trim(snippet), 1, 200))"
)
D_FINDINGS = (
    f"SELECT *, {severity_sql('raw_severity')} AS severity, {relativize_sql('raw_path', 'root')} AS file_path "
    f"FROM ({duck(FINDINGS)})"
)
D_FINGERPRINTED = f"SELECT *, {FINGERPRINT_SQL} AS fingerprint FROM ({D_FINDINGS})"
D_SCANS = duck(SCANS)
D_PROJECTS = duck(PROJECTS)
D_TARGETS = duck(TARGETS)
D_EVENTS = duck(EVENTS)
D_TRIAGE = duck(TRIAGE)
D_FILES = duck(FILES)
D_DOC_FINDINGS = duck(DOC_FINDINGS, files_sql=D_FILES)
D_RULE_FILES = duck(RULE_FILES)
D_ENGINE_RUNS = (
    "SELECT scan_id, engine, arg_max(state, event_id) AS state, arg_max(kind, event_id) AS kind "
    f"FROM ({D_EVENTS}) GROUP BY scan_id, engine"
)
D_DEDUPED = (
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, fingerprint ORDER BY ordinal, finding_id) AS rn "
    f"FROM ({D_FINGERPRINTED})) WHERE rn = 1"
)
