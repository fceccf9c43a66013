"""Registered queries: the scan job, sinks, detectors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.operators import detect, dedup, detectors, triage
from findmill.plans import scan_job, views as v
from findmill.plans.q_findings import _redact_sql
from findmill.plans.q_lines import D_LINES
from findmill.operators import report
from findmill.session import materialise, work_dir
from findmill.sources import findings_store, sinks

Q: dict = {}

_BASE = (
    "SELECT f.finding_id, cast(substr(f.project, 4) AS bigint) AS scan_id, f.project, f.file_path, f.line_start, coalesce(f.line_end, f.line_start) AS line_end, "
    "f.rule_id, regexp_extract(c.content, '^[A-Za-z]+', 0) AS word FROM ({doc_findings}) f JOIN ({files_sql}) c ON f.project = c.project AND f.file_path = c.path"
)


def _doc_reports(spark, sf):
    """Reports on the corpus: every third finding by each of three engines, bandit says it twice."""
    base = v._run(spark, sf, _BASE, doc_findings=v.DOC_FINDINGS.replace("{files_sql}", v.FILES), files_sql=v.FILES)
    i = F.col("finding_id") % 3
    full = F.concat(F.lit("/work/"), "project", F.lit("/"), "file_path")

    def hit(path):
        return F.struct(
            F.col("rule_id").alias("test_id"), F.lit("HIGH").alias("issue_severity"), F.lit("low").alias("issue_confidence"), path.alias("filename"),
            F.col("line_start").alias("line_number"), F.lit("1    call()\n").alias("code"), F.lit("text").alias("issue_text"), F.lit("https://m").alias("more_info"),
        )

    bandit = F.to_json(F.struct(F.array(hit(full), hit(F.col("file_path"))).alias("results")))
    opengrep = F.concat(
        F.lit('{"results": [{"check_id": "home.'), "rule_id", F.lit('", "path": "'), full, F.lit('", "start": {"line": '), F.col("line_start").cast("string"),
        F.lit(', "col": 1}, "end": {"line": '), F.col("line_end").cast("string"),
        F.lit(', "col": 2}, "extra": {"severity": "ERROR", "message": "m", "lines": "requires login", "metadata": {"cwe": ["CWE-1"], "owasp": "A1"}}}]}'),
    )
    gitleaks = F.to_json(
        F.array(
            F.struct(
                F.col("rule_id").alias("RuleID"), full.alias("File"), F.col("line_start").alias("StartLine"), F.col("line_end").alias("EndLine"),
                F.col("word").alias("Secret"), F.concat(F.lit("is "), "word").alias("Match"), F.lit("d").alias("Description"),
            )
        )
    )
    return base.select(
        F.col("finding_id").alias("report_id"), "scan_id", "project",
        F.when(i == 0, "bandit").when(i == 1, "opengrep").otherwise("gitleaks").alias("engine"),
        F.when(i == 0, bandit).when(i == 1, opengrep).otherwise(gitleaks).alias("body"),
    )


def scan_findings(spark, sf):
    ranges = v.files(spark, sf).where("doc_id % 2 = 0").selectExpr(
        "cast(substr(project, 4) AS bigint) AS scan_id", "path", "cast(1 AS int) AS start", "cast(10 AS int) AS end"
    )
    scans = v.files(spark, sf).selectExpr("cast(substr(project, 4) AS bigint) AS scan_id").where("scan_id <> 5").distinct()
    root = F.concat(F.lit("/work/"), "project")
    return scan_job.scan_findings(_doc_reports(spark, sf), v.files(spark, sf), ranges, root, scans)


def _scan_findings_view(spark, sf):
    out = scan_findings(spark, sf)
    ctx = F.from_json("evidence", "context array<struct<line:int,text:string,vulnerable:boolean>>")["context"]
    return out.select(
        "scan_id", "tool", "rule_id", "severity", "file_path", "line_start", "fingerprint", "in_pr_diff", "snippet",
        F.sha2(F.array_join(F.transform(ctx, lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["text"])), "\n"), 256).alias("context_sha"),
    )


_CTX_TEXT = _redact_sql("CASE WHEN tool = 'gitleaks' AND length(word) >= 4 THEN replace(text, word, '[REDACTED]') ELSE text END")
_READ = _redact_sql("coalesce(src, '')")
Q["scan_findings"] = (
    _scan_findings_view,
    "WITH f AS (SELECT b.*, CASE b.finding_id % 3 WHEN 0 THEN 'bandit' WHEN 1 THEN 'opengrep' ELSE 'gitleaks' END AS tool, c.doc_id FROM ("
    + _BASE.replace("{doc_findings}", v.D_DOC_FINDINGS).replace("{files_sql}", v.D_FILES)
    + f") b JOIN ({v.D_FILES}) c ON b.project = c.project AND b.file_path = c.path WHERE b.scan_id <> 5), "
    # bandit reports one line only.
    "e AS (SELECT * REPLACE (CASE WHEN tool = 'bandit' THEN line_start ELSE line_end END AS line_end) FROM f), "
    f"l AS ({D_LINES}), j AS (SELECT e.finding_id, e.tool, e.word, l.line, l.text, l.bytes, e.line_start, e.line_end FROM e JOIN l ON e.project = l.project AND e.file_path = l.path "
    "AND l.line BETWEEN greatest(1, e.line_start - 4) AND e.line_end + 4), "
    "c AS (SELECT *, row_number() OVER w AS n, sum(octet_length(encode(CASE WHEN bytes > 8192 THEN '[line truncated]' ELSE text END)) + 1) OVER (PARTITION BY finding_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS b "
    "FROM j WINDOW w AS (PARTITION BY finding_id ORDER BY line)), "
    f"x AS (SELECT finding_id, string_agg(line || ':' || {_CTX_TEXT.replace('(text', '(shown').replace('ELSE text', 'ELSE shown')}, chr(10) ORDER BY line) AS ctx FROM (SELECT *, CASE WHEN bytes > 8192 THEN '[line truncated]' ELSE text END AS shown FROM c) WHERE n <= 25 AND b <= 8192 GROUP BY finding_id), "
    "s AS (SELECT finding_id, substr(string_agg(text, chr(10) ORDER BY line), 1, 2000) AS src FROM j WHERE line BETWEEN line_start AND line_end GROUP BY finding_id), "
    f"o AS (SELECT e.scan_id, e.tool, e.rule_id, 'high' AS severity, e.file_path, e.line_start, e.tool <> 'gitleaks' AND doc_id % 2 = 0 AND e.line_start <= 10 AS in_pr_diff, "
    f"CASE e.tool WHEN 'bandit' THEN 'call()' WHEN 'opengrep' THEN {_READ} ELSE CASE WHEN word = '' THEN 'is ' ELSE 'is [REDACTED]' END END AS snippet, coalesce(ctx, '') AS ctx "
    "FROM e LEFT JOIN x ON e.finding_id = x.finding_id LEFT JOIN s ON e.finding_id = s.finding_id) "
    f"SELECT scan_id, tool, rule_id, severity, file_path, line_start, {v.FINGERPRINT_SQL} AS fingerprint, in_pr_diff, snippet, sha256(ctx) AS context_sha FROM o",
)


def sink_findings(spark, sf):
    """Store the deduplicated findings of one run twice, the second write replaces the first; a third run is emptied."""
    path = work_dir(spark, "findings")
    found = dedup.dedup_first(v.fingerprinted(spark, sf), ["scan_id"], ["ordinal", "finding_id"])
    # computed once; a join by sorting has dealt the rows by scan already, then this deals none
    df = materialise(found.repartition("scan_id").sortWithinPartitions("scan_id", "severity"), "deduplicated")
    for _ in range(2):
        sinks.sink_findings(df, path, run_id="r1", laid_out=True)
    for rows in (df, df.where("false")):
        sinks.sink_findings(rows, path, run_id="r2", laid_out=True)
    return spark.read.parquet(path).select("finding_id", "scan_id", "severity", "fingerprint", "run_id")


Q["sink_findings"] = (
    sink_findings,
    f"SELECT finding_id, scan_id, severity, fingerprint, 'r1' AS run_id FROM ({v.D_DEDUPED})",
)


def sink_report_tables(spark, sf):
    """Write the three report tables in two runs, one of them twice, and read all of them back."""
    path = work_dir(spark, "report")
    for run in (0, 1, 0):
        f, s = (t.where(f"scan_id % 2 = {run}") for t in (v.findings(spark, sf), v.scans(spark, sf)))
        sinks.sink_report_tables(report.report_tables(f, s, v.projects(spark, sf)), path, run_id=f"r{run}")
    summary_, meta, blocks = (spark.read.parquet(f"{path}/report_{t}") for t in ("summary", "meta", "blocks"))
    counted = [t.groupBy("scan_id").agg(F.lit(o).alias("ordinal"), F.lit(n).alias("label"), F.count("*").alias("n")) for o, n, t in ((6, "meta", meta), (7, "blocks", blocks))]
    return summary_.select("scan_id", "ordinal", "label", "n").union(counted[0]).union(counted[1])


Q["sink_report_tables"] = (
    sink_report_tables,
    f"WITH s AS ({v.D_SCANS}), f AS ({v.D_FINDINGS}), d AS (SELECT s.scan_id, f.severity, f.scan_id AS has FROM s LEFT JOIN f ON s.scan_id = f.scan_id) "
    + " UNION ALL ".join(f"SELECT scan_id, {i} AS ordinal, '{x.capitalize()}' AS label, count(*) FILTER (severity = '{x}') AS n FROM d GROUP BY scan_id" for i, x in enumerate(K.SEVERITIES))
    + " UNION ALL SELECT scan_id, 5, 'Total', count(has) FROM d GROUP BY scan_id"
    f" UNION ALL SELECT scan_id, 6, 'meta', 8 FROM s WHERE project_id IN (SELECT project_id FROM ({v.D_PROJECTS}))"
    " UNION ALL SELECT scan_id, 7, 'blocks', count(*) FROM f WHERE scan_id IN (SELECT scan_id FROM s) OR true GROUP BY scan_id",
)


def triage_stored(spark, sf):
    """Findings stored, two rounds of triage for every fifth rule's findings merged into them, and the first merge once more."""
    path = work_dir(spark, "triaged")
    f = v.findings(spark, sf).withColumn("triage_reason", F.lit(""))
    findings_store.create_findings(f.select("finding_id", "scan_id", "severity", "status", "triage_reason"), path, "r0", 16)
    changed = f.where("pk % 5 = 0")
    rounds = [("first", changed.selectExpr("finding_id", "1L AS seq", "'triaged' AS to_status", "'first' AS reason")),
              ("second", changed.selectExpr("finding_id", "2L AS seq", "CASE pk % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'banana' ELSE 'triaged' END AS to_status", "'second' AS reason"))]
    for run, changes in rounds:
        audit = triage.triage_apply(changes, F.col("seq"), findings_store.read_findings(spark, path))
        findings_store.merge_triage(spark, path, triage.triage_current(audit), run)
    findings_store.merge_triage(spark, path, rounds[0][1].selectExpr("finding_id", "'new' AS status", "'again' AS triage_reason"), "first")
    return findings_store.read_findings(spark, path).select("finding_id", "scan_id", "severity", "status", "triage_reason")


Q["triage_stored"] = (
    triage_stored,
    "SELECT finding_id, scan_id, severity, CASE WHEN pk % 15 = 0 THEN 'fixed' WHEN pk % 5 = 0 THEN 'triaged' ELSE status END AS status, "
    f"CASE WHEN pk % 15 = 0 THEN 'second' WHEN pk % 5 = 0 AND status <> 'triaged' THEN 'first' ELSE '' END AS triage_reason FROM ({v.D_FINDINGS})",
)


def _long_lines(batch: pd.DataFrame) -> pd.DataFrame:
    """A detector of a user's own: the first line of each file that holds two digits in a row."""
    rows = []
    for project, path, content in zip(batch["project"], batch["path"], batch["content"]):
        for n, line in enumerate(content.split("\n"), 1):
            if re.search(r"[0-9][0-9]", line):
                rows.append({"project": project, "rule_id": "digits", "severity": "low", "file_path": path, "line_start": n})
                break
    return pd.DataFrame(rows, columns=["project", "rule_id", "severity", "file_path", "line_start"])


def detector_registry(spark, sf):
    files = v.files(spark, sf).select("project", "path", "content")
    reg = detectors.DetectorRegistry()
    reg.register(detectors.Detector("digits", "sast", detectors.pandas_detector(_long_lines)), files)
    reg.register(detectors.Detector("credentials", "secrets", detect.secret_scan), files)
    return reg.run(files).groupBy("tool", "source_type", "project").agg(F.count(F.lit(1)).alias("n"), F.sum("line_start").alias("lines"))


_DIGITS = f"SELECT project, path, min(line) AS line FROM ({D_LINES}) WHERE regexp_matches(text, '[0-9][0-9]') GROUP BY ALL"


def _creds_sql() -> str:
    from findmill import constants as K

    return " UNION ALL ".join(
        f"SELECT project, line, unnest(regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}', 0)) AS m FROM ({D_LINES})" for rx in K.CREDENTIAL_PATTERNS.values()
    )


Q["detector_registry"] = (
    detector_registry,
    f"SELECT 'digits' AS tool, 'sast' AS source_type, project, count(*) AS n, sum(line) AS lines FROM ({_DIGITS}) GROUP BY project "
    f"UNION ALL SELECT 'credentials', 'secrets', project, count(*), sum(line) FROM ({_creds_sql()}) GROUP BY project",
)


def _first_digits(project, path, content):
    """The same detector for one file at a time, as SQL calls it."""
    for n, line in enumerate(content.split("\n"), 1):
        if re.search(r"[0-9][0-9]", line):
            return [{"rule_id": "digits", "line_start": n}]
    return []


def detector_udtf(spark, sf):
    detectors.sql_detector(spark, "digits_detector", "sast", _first_digits)
    v.files(spark, sf).createOrReplaceTempView("detector_files")
    return spark.sql(
        "SELECT tool, source_type, project, count(*) AS n, sum(line_start) AS lines FROM digits_detector(TABLE(SELECT project, path, content FROM detector_files)) GROUP BY ALL"
    )


Q["detector_udtf"] = (
    detector_udtf,
    f"SELECT 'digits_detector' AS tool, 'sast' AS source_type, project, count(*) AS n, sum(line) AS lines FROM ({_DIGITS}) GROUP BY project",
)
