"""The scan job: reports, sources and diffs in, findings ready to store out. One lazy plan."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill import schemas as S
from findmill.functions import evidence as ev
from findmill.functions.findings import path_relativize
from findmill.functions.text import fingerprint, redact
from findmill.operators.context import attach_context, attach_snippet, source_of_spans, spans_of
from findmill.operators.dedup import dedup_first, with_fingerprint
from findmill.operators.diff import diff_interval_match
from findmill.operators.findings import live_scan_guard
from findmill.sources.reports import INGESTERS, ingest_all
from findmill.sources.sinks import sink_findings

FINDING_COLUMNS = [
    "finding_id", "scan_id", "project", "tool", "source_type", "rule_id", "severity", "cwe", "file_path", "line_start", "line_end",
    "snippet", "description", "remediation", "fingerprint", "status", "in_pr_diff", "evidence",
]


def normalise(reports: DataFrame, root: Column, engines: list[str] | None = None) -> DataFrame:
    """Findings of the engines on relative paths; addresses of scans without a checkout stay as they are. What evidence needs of the raw document is
    taken here, so that the document itself is never shuffled."""
    raw = F.col("raw")
    return (
        ingest_all(reports, engines)
        .withColumns({"file_path": F.when(F.col("source_type") == "dast", F.col("file_path")).otherwise(path_relativize("file_path", root)), "raw": F.try_parse_json("raw")})
        .withColumns(
            {
                "_confidence": ev.evidence_confidence(raw),
                "_owasp": ev.evidence_owasp(raw),
                "_references": ev.evidence_references(raw, "remediation"),
            }
        )
        .drop("raw")
    )


def with_evidence(findings: DataFrame) -> DataFrame:
    """Redact snippet and context, fingerprint the redacted snippet, build the evidence document."""
    context = ev.evidence_context_redact("context", "source_type", "rule_id", "redaction_tokens")
    c = F.col
    doc = ev.evidence_build(
        rule_id=c("rule_id"), tool=c("tool"), file_path=c("file_path"), line_start=c("line_start"), line_end=c("line_end"),
        col_start=c("col_start"), col_end=c("col_end"), cwe=c("cwe"), confidence=c("_confidence"), owasp=c("_owasp"),
        references=c("_references"), context=context,
    )
    return (
        findings.withColumn("evidence", F.to_json(doc))
        .withColumn("snippet", redact("snippet", "redaction_tokens"))
        .withColumn("fingerprint", fingerprint("tool", "rule_id", "file_path", "line_start", "snippet"))
    )


def scan_findings(
    reports: DataFrame,
    files: DataFrame,
    ranges: DataFrame,
    root: Column,
    scans: DataFrame | None = None,
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """Findings to store.

    ``reports(report_id, scan_id, project, engine, body)``, ``files(project, path, content)``,
    ``ranges(scan_id, path, start, end)``. Paths are made relative before deduplication, which
    runs on the snippet as reported; the stored fingerprint is that of the redacted snippet.

    What is used twice is persisted: the reports' findings, which say where to look, and the source lines
    found there, which one pass over the files gives for snippets and context. Both hold exact secrets and are
    therefore never written to a shared folder; an executor that is lost takes its part along and Spark
    computes that part again. Frames to unpersist afterwards are appended to ``held``.
    """
    held = [] if held is None else held
    found = normalise(reports, root).persist(StorageLevel.MEMORY_AND_DISK)
    seen = source_of_spans(spans_of(found), files).persist(StorageLevel.MEMORY_AND_DISK)
    held += [found, seen]
    unique = dedup_first(with_fingerprint(attach_snippet(found, seen), "_fp"), ["scan_id"], ["report_id", "ordinal"], "_fp").drop("_fp")
    if scans is not None:
        unique = live_scan_guard(unique, scans)
    marked = diff_interval_match(unique, ranges)
    full = with_evidence(attach_context(marked, seen)).withColumn("status", F.lit("new"))
    # the place of a finding in its scan, as 64 bits: the same in every rerun
    return full.withColumn("finding_id", F.xxhash64("scan_id", "report_id", "ordinal")).select(*FINDING_COLUMNS)


def as_stored(findings: DataFrame, scans: DataFrame, seen_at: Column) -> DataFrame:
    """The findings table that reads, reports and triage work on (``schemas.FINDING``).

    ``scans(scan_id, project_id)`` gives the project; triage starts empty, ``seen_at`` is both times.
    """
    known = findings.join(scans.select("scan_id", "project_id"), "scan_id", "left")
    known = known.withColumns({"triage_reason": F.lit(""), "first_seen": seen_at, "last_seen": seen_at})
    return known.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.FINDING.fields])


def store_scan(
    reports: DataFrame, files: DataFrame, ranges: DataFrame, root: Column, path: str, run_id: str, scans: DataFrame | None = None,
    seen_at: Column | None = None,
) -> None:
    """Run the job and write its findings; nothing stays cached.

    With ``scans(scan_id, project_id)`` the stored rows have the columns of ``schemas.FINDING``, seen at ``seen_at`` (now).
    """
    held: list[DataFrame] = []
    try:
        found = scan_findings(reports, files, ranges, root, scans, held)
        if scans is not None and "project_id" in scans.columns:
            found = as_stored(found, scans, F.current_timestamp() if seen_at is None else seen_at)
        sink_findings(found, path, run_id)
    finally:
        for df in held:
            df.unpersist()
