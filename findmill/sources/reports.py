"""Detector reports -> findings in one schema.

Input is always ``reports(report_id, engine, body)`` plus any key columns, which are
carried through. Every ingest function emits the key columns, ``ordinal`` (the place of
the finding in its report) and the columns of ``schemas.RAW_FINDING``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill import constants as K
from findmill import schemas as S
from findmill.functions.findings import (
    cwe_normalize,
    engine_snippet,
    rule_id_clean,
    sev_normalize,
    snippet_marked_lines,
    trivy_remediation,
    zap_severity,
)
from findmill.functions.text import first_int, first_text, let, redact_match, text_or_empty

_NO_TOKENS = "array()"


def _is_object(v: Column) -> Column:
    """Only objects become structs; no value below is read."""
    return F.try_variant_get(v, "$", "struct<_:boolean>").isNotNull()


#: The parsed body; one column, so that every later step reads the same parse.
_DOC = "_doc"
#: The list its entries stand in, null where there is none; cut out once, as every cut copies the entries.
_LIST = "_list"
_LIST_PATHS = {"bandit": "$.results", "opengrep": "$.results", "trivy": "$.Results", "gitleaks": "$", "zap": "$.alerts"}


def parse_reports(reports: DataFrame) -> DataFrame:
    """Reports with their body as a variant, and a kind and a reason on those that are quarantined. Bodies are parsed here only."""
    v, unlisted = F.col(_DOC), F.col(_LIST).isNull()
    meta_ok = F.coalesce(
        F.schema_of_variant(F.try_variant_get(v, "$.SchemaVersion", "variant")).isin("BIGINT", "BOOLEAN"), F.lit(False)
    ) & F.coalesce(
        F.schema_of_variant(F.try_variant_get(v, "$.ArtifactName", "variant")) == "STRING", F.lit(False)
    )

    def absent(path: str) -> Column:
        found = F.try_variant_get(v, path, "variant")
        return found.isNull() | F.is_variant_null(found)

    engine = F.col("engine")
    reason = (
        F.when(v.isNull(), F.lit("invalid JSON"))
        .when(engine.isin("bandit", "opengrep") & unlisted, "missing a results array")
        .when((engine == "gitleaks") & unlisted, "report must be a JSON array")
        .when((engine == "trivy") & ~meta_ok, "missing required report metadata")
        .when((engine == "trivy") & unlisted & ~absent("$.Results"), "Results must be an array or null")
        .when((engine == "zap") & unlisted & ~_is_object(v), "report must be a JSON object")
        .when((engine == "zap") & unlisted & ~absent("$.alerts"), "alerts must be an array")
    )
    listed = _by_engine(list(_LIST_PATHS), lambda e: F.try_variant_get(v, _LIST_PATHS[e], "array<variant>"))
    parsed = reports.withColumn(_DOC, F.try_parse_json("body")).withColumn(_LIST, listed).withColumn("reason", reason)
    return parsed.withColumn("kind", F.when(F.col("reason").isNotNull(), "malformed_output"))


def ingest_report_envelope(reports: DataFrame) -> DataFrame:
    """Mark each report good (``kind`` null) or quarantined with a kind and a reason."""
    return parse_reports(reports).drop(_DOC, _LIST)


def _keys(reports: DataFrame) -> list[str]:
    return [c for c in reports.columns if c not in ("engine", "body", "kind", "reason", _DOC, _LIST)]


def _text(r: Column, path: str) -> Column:
    return F.try_variant_get(r, path, "string")


def _int(c: Column) -> Column:
    return c.try_cast("int")


#: What is read of an entry, by engine, cut out in one pass over its fields. Numbers are bigint, the type they are stored in.
_FIELDS = {
    "bandit": "test_id string, issue_severity string, issue_cwe struct<id:bigint>, filename string, line_number bigint, "
    "col_offset bigint, end_col_offset bigint, code string, issue_text string, more_info string",
    "opengrep": "check_id string, path string, start struct<line:bigint,col:bigint>, `end` struct<line:bigint,col:bigint>, "
    "extra struct<severity:string,lines:string,message:string,fix:string,metadata:struct<severity:string,category:string,cwe:variant>>",
    "trivy": "VulnerabilityID string, Severity string, CweIDs array<string>, Description string, PkgName string, "
    "InstalledVersion string, FixedVersion string, References array<string>",
    "gitleaks": "Secret string, RuleID string, File string, StartLine string, EndLine string, Match string, Description string",
    "zap": "pluginId string, alertRef string, risk string, cweid string, url string, param string, alert string, "
    "description string, solution string",
}


def _fields(engine: str) -> Column:
    return F.when(F.col("engine") == engine, F.try_variant_get(F.col("r"), "$", f"struct<{_FIELDS[engine]}>"))


def _bandit(f: Column, r: Column, target: Column) -> dict[str, Column]:
    cwe_id = _int(f["issue_cwe"]["id"])
    return dict(
        rule_id=text_or_empty(f["test_id"]),
        severity=sev_normalize(f["issue_severity"]),
        cwe=F.when(F.coalesce(cwe_id, F.lit(0)) != 0, F.concat(F.lit("CWE-"), cwe_id.cast("string"))).otherwise(""),
        file_path=text_or_empty(f["filename"]),
        line_start=_int(f["line_number"]),
        line_end=_int(f["line_number"]),
        col_start=_int(f["col_offset"]),
        col_end=_int(f["end_col_offset"]),
        snippet=snippet_marked_lines(f["code"]),
        description=text_or_empty(f["issue_text"]),
        remediation=text_or_empty(f["more_info"]),
        raw=F.to_json(r),
    )


def _opengrep(f: Column, r: Column, target: Column) -> dict[str, Column]:
    extra, meta = f["extra"], f["extra"]["metadata"]
    base = sev_normalize(first_text(extra["severity"], meta["severity"], F.lit("warning")))
    security = F.coalesce(meta["category"] == "security", F.lit(False))
    return dict(
        rule_id=rule_id_clean(f["check_id"]),
        severity=let(base, lambda b: F.when((b == "info") & security, "medium").otherwise(b)),
        cwe=cwe_normalize(meta["cwe"]),
        file_path=text_or_empty(f["path"]),
        line_start=_int(f["start"]["line"]),
        line_end=_int(f["end"]["line"]),
        col_start=_int(f["start"]["col"]),
        col_end=_int(f["end"]["col"]),
        snippet=engine_snippet(extra["lines"]),
        description=text_or_empty(extra["message"]),
        remediation=text_or_empty(extra["fix"]),
        raw=F.to_json(r),
    )


def _trivy(f: Column, r: Column, target: Column) -> dict[str, Column]:
    return dict(
        rule_id=text_or_empty(f["VulnerabilityID"]),
        severity=sev_normalize(f["Severity"]),
        cwe=text_or_empty(F.get(f["CweIDs"], 0)),
        file_path=text_or_empty(target),
        description=F.substring(text_or_empty(f["Description"]), 1, 1000),
        remediation=trivy_remediation(f["PkgName"], f["InstalledVersion"], f["FixedVersion"], f["References"]),
        raw=F.to_json(r),
    )


def _gitleaks(f: Column, r: Column, target: Column) -> dict[str, Column]:
    """The secret lives on only in ``redaction_tokens``, which no sink accepts."""
    secret = text_or_empty(f["Secret"])
    safe = F.map_filter(F.try_variant_get(r, "$", "map<string,variant>"), lambda k, v: ~k.isin("Secret", "secret", "Match", "match"))
    return dict(
        rule_id=text_or_empty(f["RuleID"]),
        severity=F.lit("high"),
        file_path=text_or_empty(f["File"]),
        line_start=f["StartLine"].try_cast("int"),
        line_end=f["EndLine"].try_cast("int"),
        snippet=redact_match(f["Match"], secret),
        description=F.substring(text_or_empty(f["Description"]), 1, 1000),
        remediation=F.lit(K.LEAK_REMEDIATION),
        raw=F.to_json(safe),
        redaction_tokens=F.when(secret != "", F.array(secret)).otherwise(F.expr("cast(array() as array<string>)")),
    )


def _zap(f: Column, r: Column, target: Column) -> dict[str, Column]:
    url, param, cwe = (text_or_empty(f[c]) for c in ("url", "param", "cweid"))
    return dict(
        rule_id=first_text(f["pluginId"], f["alertRef"]),
        severity=zap_severity(first_int(f["risk"])),
        cwe=F.when(cwe != "", F.concat(F.lit("CWE-"), cwe)).otherwise(""),
        file_path=url,
        snippet=F.when(param != "", F.concat(url, F.lit(" (param: "), param, F.lit(")"))).otherwise(url),
        description=first_text(f["alert"], F.substring(text_or_empty(f["description"]), 1, 1500)),
        remediation=text_or_empty(f["solution"]),
        raw=F.to_json(r),
    )


def _listed() -> Column:
    """The entries of the list, numbered from 0."""
    return F.transform(F.col(_LIST), lambda r, i: F.struct(i.cast("long").alias("ordinal"), F.lit(None).cast("string").alias("target"), r.alias("r")))


def _vulnerabilities() -> Column:
    """The entries below every target. Position in the report: target first, then vulnerability."""

    def below(t: Column, i: Column) -> Column:
        found = F.coalesce(F.try_variant_get(t, "$.Vulnerabilities", "array<variant>"), F.expr("cast(array() as array<variant>)"))
        place = i.cast("long") * F.lit(1 << 31)
        return F.transform(found, lambda r, j: F.struct((place + j).alias("ordinal"), _text(t, "$.Target").alias("target"), r.alias("r")))

    return F.flatten(F.transform(F.col(_LIST), below))


_ENGINES = {
    "bandit": (_listed, _bandit),
    "opengrep": (_listed, _opengrep),
    "trivy": (_vulnerabilities, _trivy),
    "gitleaks": (_listed, _gitleaks),
    "zap": (_listed, _zap),
}


def _finding(engine: str, given: dict[str, Column]) -> list[Column]:
    """All columns of a finding: what an engine doesn't deliver is blank or null."""
    given = {"tool": F.lit(engine), "source_type": F.lit(K.ENGINE_SOURCE_TYPE[engine]), **given}
    out = []
    for field in S.RAW_FINDING.fields:
        if field.name in given:
            c = given[field.name]
        elif field.name == "redaction_tokens":
            c = F.expr(_NO_TOKENS)
        elif field.dataType.simpleString() == "string":
            c = F.lit("")
        else:
            c = F.lit(None)
        out.append(c.cast(field.dataType).alias(field.name))
    return out


def _by_engine(engines: list[str], make) -> Column:
    out = None
    for e in engines:
        out = F.when(F.col("engine") == e, make(e)) if out is None else out.when(F.col("engine") == e, make(e))
    return out


def findings_of(parsed: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """Findings of reports that ``parse_reports`` let pass: one pass over them, whatever the number of engines.

    A quarantined report has no entries. It isn't filtered out, as a filter would move below the parse and parse for itself.
    """
    names, keys = list(engines or _ENGINES), _keys(parsed)
    listed = F.when(F.col("kind").isNull(), _by_engine(names, lambda e: _ENGINES[e][0]()))
    entries = parsed.select(*keys, "engine", F.inline(listed)).select("*", *[_fields(e).alias(f"_{e}") for e in names])
    columns = {e: _finding(e, _ENGINES[e][1](F.col(f"_{e}"), F.col("r"), F.col("target"))) for e in names}
    if len(names) == 1:
        return entries.select(*keys, "ordinal", *columns[names[0]])
    # a choice per column, not one of whole rows: columns nobody reads are not computed
    chosen = [_by_engine(names, lambda e, i=i: columns[e][i]).alias(f.name) for i, f in enumerate(S.RAW_FINDING.fields)]
    return entries.select(*keys, "ordinal", *chosen)


def ingest_bandit(reports: DataFrame) -> DataFrame:
    return ingest_all(reports, ["bandit"])


def ingest_opengrep(reports: DataFrame) -> DataFrame:
    """``snippet`` is null where the engine sent none; ``snippet_fallback`` reads the source then."""
    return ingest_all(reports, ["opengrep"])


def ingest_trivy(reports: DataFrame) -> DataFrame:
    return ingest_all(reports, ["trivy"])


def ingest_gitleaks(reports: DataFrame) -> DataFrame:
    return ingest_all(reports, ["gitleaks"])


def ingest_zap_alerts(reports: DataFrame) -> DataFrame:
    return ingest_all(reports, ["zap"])


INGESTERS = {"bandit": ingest_bandit, "opengrep": ingest_opengrep, "trivy": ingest_trivy, "gitleaks": ingest_gitleaks, "zap": ingest_zap_alerts}


def union_engines(frames: list[DataFrame]) -> DataFrame:
    """Findings of all engines that completed; an engine that failed just adds no rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ingest_all(reports: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """All engines (or those named) in one pass; quarantined reports give no rows (``ingest_report_envelope`` says why).

    Reports that are of no named engine are not parsed.
    """
    own = reports if engines is None else reports.where(F.col("engine").isin(*engines))
    return findings_of(parse_reports(own), engines)
