"""Report tables: header, severity summary, finding blocks in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.functions.findings import finding_header, finding_location
from findmill.functions.text import first_text, format_timestamp, markup_escape, strip, text_or_empty
from findmill.operators.summary import severity_summary

SECTION_PR_ONLY = "Findings in Pull Request Changed Code"
SECTION_CHANGED = "Findings in Your Changed Code (this PR)"
SECTION_EXISTING = "Pre-existing Findings in This Repository"
SECTION_ALL = "Findings"


def report_sections(findings: DataFrame, key: str = "scan_id", pr_only: bool = False) -> DataFrame:
    """Section title and place of every finding.

    Whether a report has changed-code findings is an aggregate joined back, not a window
    over the report, so one report may hold any share of the table.
    """
    if pr_only:
        return findings.where("in_pr_diff").withColumn("section", F.lit(SECTION_PR_ONLY)).withColumn("section_ord", F.lit(0))
    any_pr = findings.groupBy(key).agg(F.bool_or("in_pr_diff").alias("_any"))
    out = findings.join(any_pr, key)
    title = (
        F.when(~F.col("_any"), SECTION_ALL).when(F.col("in_pr_diff"), SECTION_CHANGED).otherwise(SECTION_EXISTING)
    )
    place = F.when(F.col("_any") & ~F.col("in_pr_diff"), 1).otherwise(0)
    return out.withColumn("section", title).withColumn("section_ord", place).drop("_any")


def report_blocks(findings: DataFrame, key: str = "scan_id", pr_only: bool = False) -> DataFrame:
    """Display texts of every finding; markup in scanned text stays literal."""
    s = report_sections(findings, key, pr_only)
    rem = strip(text_or_empty("remediation"))
    return s.select(
        key,
        "finding_id",
        "section_ord",
        "section",
        markup_escape(finding_header("severity", "tool", "rule_id", "cwe")).alias("header"),
        markup_escape(F.concat(F.lit("Location: "), finding_location("file_path", "line_start"))).alias("location"),
        markup_escape(strip(first_text("description", F.lit("-")))).alias("description"),
        F.substring("snippet", 1, 1200).alias("snippet"),
        F.when(rem != "", F.concat(F.lit("<b>Remediation:</b> "), markup_escape(rem))).otherwise("").alias("remediation"),
    )


def report_meta(scans: DataFrame, projects: DataFrame) -> DataFrame:
    """Header lines of each scan report as (scan_id, ordinal, label, value); markup in values stays literal."""
    p = projects.select("project_id", "name", "workspace", "repo_slug")
    j = scans.join(p, "project_id")
    lines: list[tuple[str, Column]] = [
        ("Project", F.col("name")),
        ("Repository", F.concat("workspace", F.lit("/"), "repo_slug")),
        ("Scan type", F.upper("scan_type")),
        ("Scope", F.concat("ref_type", F.lit(": "), text_or_empty("ref_name"))),
        ("Commit", first_text("commit_sha", F.lit("-"))),
        ("Engines", first_text("engines", F.lit("auto"))),
        ("Run date", format_timestamp("created_at")),
        ("Status", F.col("status")),
    ]
    rows = F.array(
        *[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("label"), markup_escape(v).alias("value")) for i, (k, v) in enumerate(lines)]
    )
    return j.select("scan_id", F.inline(rows))


def project_report_meta(projects: DataFrame, generated_at: Column, pr_only: bool = False) -> DataFrame:
    scope = "Findings in PR-changed code only" if pr_only else "All findings"
    lines: list[tuple[str, Column]] = [
        ("Project", F.col("name")),
        ("Repository", F.concat("workspace", F.lit("/"), "repo_slug")),
        ("Scope", F.lit(scope)),
        ("Generated", format_timestamp(generated_at)),
    ]
    rows = F.array(
        *[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("label"), markup_escape(v).alias("value")) for i, (k, v) in enumerate(lines)]
    )
    return projects.select("project_id", F.inline(rows))


def project_report(findings: DataFrame, projects: DataFrame, generated_at: Column, pr_only: bool = False) -> dict[str, DataFrame]:
    """Report tables of every project: header, severity counts and blocks of its findings, those in changed code alone if ``pr_only``."""
    shown = findings.where("in_pr_diff") if pr_only else findings
    return {
        "report_meta": project_report_meta(projects, generated_at, pr_only),
        "report_summary": severity_summary(shown, ["project_id"], projects),
        "report_blocks": report_blocks(findings, "project_id", pr_only),
    }


def report_tables(findings: DataFrame, scans: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    return {
        "report_meta": report_meta(scans, projects),
        "report_summary": severity_summary(findings, ["scan_id"], scans),
        "report_blocks": report_blocks(findings),
    }
