"""Registered queries over source texts: lines, context, snippets, detection, languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions import evidence as ev
from findmill.operators import context, detect
from findmill.plans import views as v
from findmill.plans.q_findings import _redact_sql
from findmill.sources import corpus, rulepack

Q: dict = {}

# Numbered lines of every file; trailing empty piece dropped.
D_LINES = (
    "SELECT doc_id, project, path, n AS line, regexp_replace(parts[n], '\\r+$', '') AS text, octet_length(encode(parts[n])) AS bytes FROM "
    "(SELECT *, unnest(generate_series(1, CASE WHEN parts[len(parts)] = '' THEN len(parts) - 1 ELSE len(parts) END)) AS n FROM "
    f"(SELECT doc_id, project, path, string_split(content, chr(10)) AS parts FROM ({v.D_FILES})))"
)

Q["source_lines"] = (
    lambda s, d: corpus.source_lines(v.files(s, d)).select("doc_id", "line", "text", "bytes"),
    f"SELECT doc_id, line, text, bytes FROM ({D_LINES})",
)

_D_LANGS = (
    "SELECT project, list(DISTINCT lang) AS langs FROM (SELECT project, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' "
    f"WHEN lower(path) LIKE '%.tf' THEN 'hcl' WHEN path LIKE '%.vue' THEN 'vue' END AS lang FROM ({v.D_FILES}) WHERE path NOT LIKE '.%' AND path NOT LIKE '%/.%') "
    "WHERE lang IS NOT NULL GROUP BY project"
)
_D_LANG_TEXT = (
    "SELECT project, array_to_string(list_transform(list_sort(list_transform(langs, lambda x: CASE x WHEN 'python' THEN '00' WHEN 'java' THEN '01' "
    f"WHEN 'javascript' THEN '02' ELSE '99' END || x)), lambda x: substr(x, 3)), ',') AS languages FROM ({_D_LANGS})"
)


def _overrides(spark, sf):
    """Every fourth source overrides its languages; regions have no files but an override."""
    files = v.files(spark, sf).select("project").distinct()
    given = files.select("project", F.when(F.col("project").endswith("3"), "go").otherwise("").alias("language_override"))
    regions = v.load(spark, sf, "region").select(F.col("r_name").alias("project"), F.lit("java").alias("language_override"))
    return given.unionByName(regions)


Q["language_inventory"] = (
    lambda s, d: corpus.language_inventory(v.files(s, d), _overrides(s, d)).select(
        "project", F.array_join("languages", ",").alias("languages")
    ),
    f"SELECT project, CASE WHEN project LIKE '%3' THEN 'go' ELSE languages END AS languages FROM ({_D_LANG_TEXT}) UNION ALL SELECT r_name, 'java' FROM region",
)
Q["languages_order"] = (
    lambda s, d: corpus.language_inventory(v.files(s, d)).select("project", F.array_join("languages", ",").alias("languages")),
    _D_LANG_TEXT,
)
Q["supported_languages"] = (
    lambda s, d: corpus.language_inventory(v.files(s, d)).select(
        "project", F.array_join(corpus.supported_languages("languages"), ",").alias("languages")
    ),
    f"SELECT project, array_to_string(list_filter(string_split(languages, ','), lambda x: x <> 'vue'), ',') AS languages FROM ({_D_LANG_TEXT})",
)

# ---------------------------------------------------------------- context
_D_CTX = (
    "WITH f AS (" + v.D_DOC_FINDINGS + "), l AS (" + D_LINES + "), j AS (SELECT f.finding_id, l.line, "
    "CASE WHEN l.bytes > 8192 THEN '[line truncated]' ELSE l.text END AS text, "
    "l.line BETWEEN f.line_start AND coalesce(f.line_end, f.line_start) AS vulnerable "
    "FROM f JOIN l ON f.project = l.project AND f.file_path = l.path AND l.line BETWEEN greatest(1, f.line_start - 4) AND coalesce(f.line_end, f.line_start) + 4), "
    "c AS (SELECT *, row_number() OVER w AS n, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY finding_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS b "
    "FROM j WINDOW w AS (PARTITION BY finding_id ORDER BY line)) "
)


def context_join(spark, sf):
    ctx = context.context_join(v.doc_findings(spark, sf), v.files(spark, sf))
    return ctx.select("finding_id", F.explode("context").alias("c")).select("finding_id", "c.line", "c.text", "c.vulnerable")


Q["context_join"] = (context_join, _D_CTX + "SELECT finding_id, line, text, vulnerable FROM c WHERE n <= 25 AND b <= 8192")


def context_cap(spark, sf):
    """First lines of every document within 12 lines and 600 bytes."""
    lines = corpus.source_lines(v.files(spark, sf))
    return context.context_cap(lines, ["doc_id"], "line", F.col("bytes") + 1, 12, 600).select("doc_id", "line")


Q["context_cap"] = (
    context_cap,
    "SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER w AS n, sum(bytes + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS b "
    f"FROM ({D_LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY line)) WHERE n <= 12 AND b <= 600",
)
Q["snippet_fallback"] = (
    lambda s, d: context.snippet_fallback(v.doc_findings(s, d), v.files(s, d)).select("finding_id", "snippet"),
    "WITH f AS (" + v.D_DOC_FINDINGS + "), l AS (" + D_LINES + "), r AS (SELECT f.finding_id, substr(string_agg(l.text, chr(10) ORDER BY l.line), 1, 2000) AS t "
    "FROM f JOIN l ON f.project = l.project AND f.file_path = l.path AND l.line BETWEEN f.line_start AND coalesce(f.line_end, f.line_start) GROUP BY f.finding_id) "
    "SELECT f.finding_id, coalesce(f.snippet, r.t, '') AS snippet FROM f LEFT JOIN r ON f.finding_id = r.finding_id",
)


def evidence_context_redact(spark, sf):
    """Context lines after redaction; the first word of each document is the exact token."""
    f = v.doc_findings(spark, sf).withColumn(
        "rule_id", F.when(F.col("finding_id") % 3 == 0, "generic.SECRET.x").otherwise(F.col("rule_id"))
    )
    ctx = context.context_join(f, v.files(spark, sf))
    tok = F.array(F.coalesce(F.get(F.split(F.get("context", 0)["text"], " "), 0), F.lit("")))
    red = ctx.select("finding_id", F.explode(ev.evidence_context_redact("context", "source_type", "rule_id", tok)).alias("c"))
    return red.select("finding_id", "c.line", "c.text")


Q["evidence_context_redact"] = (
    evidence_context_redact,
    _D_CTX + ", k AS (SELECT finding_id, line, text, string_split(first_value(text) OVER (PARTITION BY finding_id ORDER BY line), ' ')[1] AS tok "
    "FROM c WHERE n <= 25 AND b <= 8192) SELECT finding_id, line, "
    + _redact_sql("CASE WHEN finding_id % 3 = 0 AND length(tok) >= 4 THEN replace(text, tok, '[REDACTED]') ELSE text END")
    + " AS text FROM k",
)


def evidence_build(spark, sf):
    """Evidence documents as JSON text."""
    f = v.doc_findings(spark, sf).withColumn("rule_id", F.concat(F.lit("r"), F.col("finding_id") % 4))
    none = F.array().cast("array<string>")
    doc = ev.evidence_build(
        rule_id=F.col("rule_id"), tool=F.lit("bandit"), file_path=F.col("file_path"), line_start=F.col("line_start"),
        line_end=F.col("line_end"), col_start=F.lit(1), col_end=F.lit(2),
        cwe=F.when(F.col("finding_id") % 2 == 0, "CWE-9").otherwise(""),
        confidence=F.lit(""), owasp=F.when(F.col("finding_id") % 3 == 0, "A03").otherwise(""),
        references=F.when(F.col("finding_id") % 5 == 0, F.array(F.lit("https://r"))).otherwise(none),
        context=F.lit(None).cast("array<struct<line:int,text:string,vulnerable:boolean>>"),
    )
    return f.select("finding_id", F.to_json(doc).alias("evidence"))


Q["evidence_build"] = (
    evidence_build,
    "SELECT finding_id, '{\"version\":1,\"file\":\"' || file_path || '\",\"start\":{\"line\":' || line_start || ',\"column\":1},\"end\":{\"line\":' || "
    "coalesce(line_end, line_start) || ',\"column\":2},\"rule\":{\"id\":\"r' || finding_id % 4 || '\",\"tool\":\"bandit\"}' || "
    "CASE WHEN finding_id % 2 = 0 THEN ',\"cwe\":\"CWE-9\"' ELSE '' END || CASE WHEN finding_id % 3 = 0 THEN ',\"owasp\":\"A03\"' ELSE '' END || "
    f"CASE WHEN finding_id % 5 = 0 THEN ',\"references\":[\"https://r\"]' ELSE '' END || '}}' AS evidence FROM ({v.D_DOC_FINDINGS})",
)

_RAW = (
    "CASE l_partkey % 5 WHEN 0 THEN '{\"issue_confidence\": \"high\", \"more_info\": \"https://m\"}' "
    "WHEN 1 THEN '{\"confidence\": \"\", \"extra\": {\"metadata\": {\"confidence\": \"low\", \"owasp\": \"A1\", \"references\": \"https://one\"}}}' "
    "WHEN 2 THEN '{\"extra\": {\"metadata\": {\"owasp\": [\"A' || cast(l_suppkey AS string) || '\", \"A2\"], \"references\": [\"https://a\", \"https://b\"]}}}' "
    "WHEN 3 THEN '[]' ELSE '{\"extra\": null, \"more_info\": 5}' END"
)
_REM = "CASE WHEN l_linenumber % 2 = 0 THEN 'https://fix' ELSE 'httpx' END"


def evidence_parts(spark, sf):
    li = v.load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_RAW} AS raw", f"{_REM} AS rem")
    j = li.withColumn("raw", F.parse_json("raw"))
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ev.evidence_confidence("raw").alias("confidence"),
        ev.evidence_owasp("raw").alias("owasp"), F.array_join(ev.evidence_references("raw", "rem"), " ").alias("refs"),
    )


Q["evidence_references"] = (
    evidence_parts,
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE '' END AS confidence, "
    "CASE l_partkey % 5 WHEN 1 THEN 'A1' WHEN 2 THEN 'A' || cast(l_suppkey AS string) ELSE '' END AS owasp, "
    "ltrim(CASE l_partkey % 5 WHEN 0 THEN 'https://m ' WHEN 1 THEN 'https://one ' WHEN 2 THEN 'https://a https://b ' ELSE '' END || "
    "CASE WHEN l_linenumber % 2 = 0 THEN 'https://fix' ELSE 'httpx' END) AS refs FROM lineitem",
)
for _name, _col in (("evidence_confidence", "confidence"), ("evidence_owasp", "owasp")):
    Q[_name] = (
        lambda s, d, c=_col: evidence_parts(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c),
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_col} FROM ({Q['evidence_references'][1]})",
    )
Q["evidence_parse"] = (
    lambda s, d: v.load(s, d, "lineitem")
    .selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CASE l_partkey % 4 WHEN 0 THEN '{\"version\": 1}' WHEN 1 THEN '[1]' WHEN 2 THEN '{broken' END AS t")
    .select("l_orderkey", "l_linenumber", "l_partkey", F.to_json(ev.evidence_parse("t")).alias("evidence")),
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 0 THEN '{\"version\":1}' ELSE '{}' END AS evidence FROM lineitem",
)


# ---------------------------------------------------------------- detection
def _corpus(spark, sf):
    """Documents, pages and conversation turns as one source corpus."""
    docs = v.load(spark, sf, "documents").select(F.lit("documents").alias("project"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    pages = v.load(spark, sf, "pages").select(F.lit("pages").alias("project"), F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    conv = v.load(spark, sf, "conversations").select(
        F.lit("conversations").alias("project"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content")
    )
    return docs.unionByName(pages).unionByName(conv)


_D_CORPUS = (
    "SELECT 'documents' AS project, cast(doc_id AS string) AS path, text AS content FROM documents UNION ALL SELECT 'pages', cast(page_id AS string), html FROM pages "
    "UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations"
)


def secret_scan(spark, sf):
    hits = detect.secret_scan(_corpus(spark, sf))
    return hits.select("project", "file_path", "line_start", "rule_id", F.sha2(F.col("redaction_tokens")[0], 256).alias("match_sha"), "snippet")


def _secret_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT project, path, line, text, 'secret.{name}' AS rule_id, unnest(regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}', 0)) AS m FROM l"
        for name, rx in K.CREDENTIAL_PATTERNS.items()
    )
    return (
        f"WITH l AS (SELECT project, path, generate_subscripts(parts, 1) AS line, unnest(parts) AS text FROM (SELECT project, path, string_split(content, chr(10)) AS parts FROM ({_D_CORPUS}))), "
        f"h AS ({arms}) SELECT project, path AS file_path, line AS line_start, rule_id, sha256(m) AS match_sha, {_redact_sql('text')} AS snippet FROM h"
    )


Q["secret_scan"] = (secret_scan, _secret_sql())

# Rules chosen to hit prose: one for all files, one per language.
_RULES = [
    detect.Rule("scp.text.long-word", ("generic",), "WARNING", "long word", "CWE-1", "security", (r"[a-z]{15,}",)),
    detect.Rule("scp.python.the-and", ("python",), "ERROR", "the and", "", "", (r"\bthe\b.{0,20}\band\b", r"^And\b")),
    detect.Rule("scp.javascript.note", ("javascript",), "note", "digit", "", "security", (r"[0-9]{2}",)),
]


def rule_scan(spark, sf):
    return detect.rule_scan(v.files(spark, sf), _RULES).select("project", "file_path", "line_start", "rule_id", "severity")


Q["rule_scan"] = (
    rule_scan,
    f"WITH l AS ({D_LINES}) SELECT project, path AS file_path, line AS line_start, 'scp.text.long-word' AS rule_id, 'medium' AS severity FROM l WHERE regexp_matches(text, '[a-z]{{15,}}') "
    "UNION ALL SELECT project, path, line, 'scp.python.the-and', 'high' FROM l WHERE path LIKE '%.py' AND (regexp_matches(text, '\\bthe\\b.{0,20}\\band\\b') OR regexp_matches(text, '^And\\b')) "
    "UNION ALL SELECT project, path, line, 'scp.javascript.note', 'medium' FROM l WHERE path LIKE '%.js' AND regexp_matches(text, '[0-9]{2}')",
)


def rule_pack_scan(spark, sf):
    """A pack of a rule file per nation, loaded and run: each looks for the first three letters of its name."""
    text = (
        "concat('rules:', chr(10), '  - id: home.scp.n', n_nationkey, chr(10), '    languages: [', CASE n_regionkey WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' ELSE 'generic' END, ']', chr(10), "
        "'    message: ', n_name, chr(10), '    severity: ', CASE n_nationkey % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END, chr(10), '    metadata:', chr(10), '      category: security', chr(10), "
        "'    pattern-regex: ', chr(39), lower(substr(n_name, 1, 3)), chr(39), chr(10))"
    )
    pack = v.load(spark, sf, "nation").selectExpr("concat('common/n', n_nationkey, '.yaml') AS path", f"cast({text} AS binary) AS content")
    # the pack is configuration: a row per rule
    rules = detect.rules_from_rows(rulepack.rule_pack_load(pack).where("file_error IS NULL").collect(), compile_calls=False)
    return detect.rule_scan(v.files(spark, sf), rules).select("project", "file_path", "line_start", "rule_id", "severity")


Q["rule_pack_scan"] = (
    rule_pack_scan,
    f"WITH l AS ({D_LINES}) SELECT project, path AS file_path, line AS line_start, 'home.scp.n' || n_nationkey AS rule_id, CASE n_nationkey % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS severity "
    "FROM l JOIN nation ON contains(text, lower(substr(n_name, 1, 3))) AND (n_regionkey IN (0, 3, 4) OR (n_regionkey = 1 AND path LIKE '%.py') OR (n_regionkey = 2 AND path LIKE '%.js'))",
)


# Python sources derived from line items: calls over one or two lines.
_CODE = (
    "'import os' || chr(10) || CASE l_partkey % 5 WHEN 0 THEN 'x = eval(f(a), b)' WHEN 1 THEN 'subprocess.run(cmd,' || chr(10) || '   shell=True, check=False)' "
    "WHEN 2 THEN 'subprocess.run(cmd, shell=False)' WHEN 3 THEN 'literal_eval(q); hashlib.md5(a); hashlib.sha1(b)' ELSE 'yaml.load(s, Loader=yaml.Loader)' END || chr(10) || 'end'"
)
CALL_RULES = [
    detect.Rule("scp.python.exec.eval", ("python",), "ERROR", "", "CWE-95", "security", tuple(map(detect.compile_call_pattern, ("eval(...)", "exec(...)")))),
    detect.Rule("scp.python.crypto.weak-md5", ("python",), "WARNING", "", "CWE-328", "security", tuple(map(detect.compile_call_pattern, ("hashlib.md5(...)", "hashlib.sha1(...)")))),
    detect.Rule("scp.python.injection.subprocess-shell", ("python",), "ERROR", "", "CWE-78", "security", (detect.compile_call_pattern("subprocess.run(..., shell=True, ...)"),)),
    detect.Rule("scp.python.deserialization.unsafe-yaml-load", ("python",), "ERROR", "", "CWE-502", "security", (detect.compile_call_pattern("yaml.load(..., Loader=yaml.Loader, ...)"),)),
]


def rule_scan_calls(spark, sf):
    src = v.load(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey AS string) AS project", "concat('a/', l_linenumber, '-', l_partkey, '-', l_suppkey, '.py') AS path", f"{_CODE} AS content"
    )
    return detect.rule_scan_calls(src, CALL_RULES).select("project", "file_path", "line_start", "rule_id", "severity")


Q["rule_scan_calls"] = (
    rule_scan_calls,
    "SELECT cast(l_orderkey AS string) AS project, 'a/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '.py' AS file_path, 2 AS line_start, "
    "CASE l_partkey % 5 WHEN 0 THEN 'scp.python.exec.eval' WHEN 1 THEN 'scp.python.injection.subprocess-shell' WHEN 3 THEN 'scp.python.crypto.weak-md5' "
    "ELSE 'scp.python.deserialization.unsafe-yaml-load' END AS rule_id, CASE WHEN l_partkey % 5 = 3 THEN 'medium' ELSE 'high' END AS severity "
    "FROM lineitem CROSS JOIN (SELECT unnest([1, 2]) AS n) WHERE l_partkey % 5 <> 2 AND (n = 1 OR l_partkey % 5 = 3)",
)
