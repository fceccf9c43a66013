"""Explicit schemas of the tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _INT, _LONG, _BOOL, _TIME = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)
_STRINGS = T.ArrayType(_STRING)


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_FINDING = _table(
    tool=_STRING, source_type=_STRING, rule_id=_STRING, severity=_STRING, cwe=_STRING,
    file_path=_STRING, line_start=_INT, line_end=_INT, col_start=_INT, col_end=_INT,
    snippet=_STRING, description=_STRING, remediation=_STRING, raw=_STRING,
    redaction_tokens=_STRINGS,
)

EVIDENCE_DDL = (
    "struct<version:int,file:string,start:struct<line:int,column:int>,"
    "end:struct<line:int,column:int>,"
    "context:array<struct<line:int,text:string,vulnerable:boolean>>,"
    "rule:struct<id:string,tool:string>,cwe:string,confidence:string,owasp:string,"
    "references:array<string>>"
)

PROJECT = _table(
    id=_LONG, name=_STRING, workspace=_STRING, repo_slug=_STRING, default_branch=_STRING,
    languages=_STRINGS, created_at=_TIME,
)
SCAN = _table(
    id=_LONG, project_id=_LONG, scan_type=_STRING, engines=_STRINGS, ref_type=_STRING, ref_name=_STRING,
    commit_sha=_STRING, language_override=_STRING, dast_target=_STRING, status=_STRING,
    engine_statuses=T.MapType(_STRING, _table(state=_STRING, findings=_INT, reason=_STRING, kind=_STRING)),
    summary=_table(
        total=_LONG, by_severity=T.MapType(_STRING, _LONG), engines=T.MapType(_STRING, _LONG), languages=_STRINGS
    ),
    progress_note=_STRING, error=_STRING, created_at=_TIME, started_at=_TIME, finished_at=_TIME,
)
FINDING = _table(
    finding_id=_LONG, scan_id=_LONG, project_id=_LONG, tool=_STRING, source_type=_STRING, rule_id=_STRING, severity=_STRING,
    cwe=_STRING, file_path=_STRING, line_start=_INT, line_end=_INT, snippet=_STRING, description=_STRING,
    remediation=_STRING, fingerprint=_STRING, status=_STRING, triage_reason=_STRING, in_pr_diff=_BOOL,
    evidence=_STRING, first_seen=_TIME, last_seen=_TIME,
)
FINDING_AUDIT_EVENT = _table(
    id=_LONG, finding_id=_LONG, from_status=_STRING, to_status=_STRING, reason=_STRING, created_at=_TIME,
)
TARGET = _table(
    id=_LONG, project_id=_LONG, name=_STRING, url=_STRING, is_production=_BOOL, pre_approved=_BOOL,
    auth_mode=_STRING, login_url=_STRING, username_field=_STRING, password_field=_STRING,
    auth_username=_STRING, auth_password=_STRING, context_file_path=_STRING, created_at=_TIME,
)
