"""Reading findings: filters, search, order, lookups, enrichment, missing parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.functions.evidence import evidence_parse
from findmill.functions.findings import sev_rank
from findmill.functions.text import contains_like

DEFAULT_LIMIT = 500
MAX_LIMIT = 5000
_FILTERS = ("scan_id", "project_id", "status", "severity", "tool", "source_type")


def text_search(df: DataFrame, q: str, columns: tuple[str, ...] = ("description", "rule_id", "file_path")) -> DataFrame:
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | contains_like(c, q)
    return df.where(hit)


def findings_filter(findings: DataFrame, *, pr_changed: bool | None = None, q: str | None = None, **equals) -> DataFrame:
    """Equality filters; an empty or zero value means no filter, ``pr_changed=False`` does filter."""
    unknown = set(equals) - set(_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = findings
    for name, value in equals.items():
        if value:
            out = out.where(F.col(name) == value)
    if pr_changed is not None:
        out = out.where(F.col("in_pr_diff") == pr_changed)
    return text_search(out, q) if q else out


def findings_order(findings: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Severity as text ascending, newest id first."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return findings.orderBy(F.col("severity").asc(), F.col("finding_id").desc()).limit(limit)


def findings_query(findings: DataFrame, *, limit: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    return findings_order(findings_filter(findings, **filters), limit)


def findings_by_risk(findings: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return findings.orderBy(sev_rank("severity").asc_nulls_last(), F.col("finding_id").desc()).limit(limit)


def scans_query(scans: DataFrame, project_id: int | None = None, status: str | None = None) -> DataFrame:
    out = scans
    if project_id:
        out = out.where(F.col("project_id") == project_id)
    if status:
        out = out.where(F.col("status") == status)
    return out.orderBy(F.col("scan_id").desc())


def detail(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the equality reaches the scan as a pushed filter."""
    return df.where(F.col(key) == value)


def finding_detail(findings: DataFrame, finding_id) -> DataFrame:
    """A finding by its id, or those whose ids a table (finding_id) asks for, with the stored evidence text parsed.

    Evidence that is no object comes back as ``{}``.
    """
    if isinstance(finding_id, DataFrame):
        found = findings.join(finding_id.select("finding_id"), "finding_id", "left_semi")
    else:
        found = detail(findings, "finding_id", finding_id)
    return found.withColumn("evidence", evidence_parse("evidence"))


def pr_only_filter(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("in_pr_diff"))


def finding_enrich(findings: DataFrame, scans: DataFrame, projects: DataFrame) -> DataFrame:
    """Finding with its scan and project. AQE broadcasts the project side when its size allows."""
    s = scans.select("scan_id", F.col("status").alias("scan_status"), "scan_type", "ref_name")
    p = projects.select("project_id", F.col("name").alias("project_name"), "workspace", "repo_slug")
    return findings.join(s, "scan_id").join(p, "project_id")


def live_scan_guard(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Drop findings whose scan is gone."""
    return findings.join(scans.select("scan_id"), "scan_id", "left_semi")


def missing_entity(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct referenced ids without a parent row."""
    ids = children.select(F.col(child_key).alias(parent_key)).where(F.col(child_key).isNotNull()).distinct()
    return ids.join(parents.select(parent_key), parent_key, "left_anti")
