"""Deduplication by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmill.functions.text import fingerprint


def with_fingerprint(findings: DataFrame, name: str = "fingerprint") -> DataFrame:
    return findings.withColumn(name, fingerprint("tool", "rule_id", "file_path", "line_start", "snippet"))


def dedup_first(
    findings: DataFrame, scope: list[str], order: list[str], fp: str = "fingerprint"
) -> DataFrame:
    """First finding per (scope, fingerprint).

    Spark keeps only the first row of each key in every input partition before it
    shuffles (WindowGroupLimit), so a fingerprint that fills the table still moves few rows.
    """
    w = Window.partitionBy(*scope, fp).orderBy(*order)
    return findings.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
