"""Writers. Each one can be repeated: a rerun replaces what the same scans wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame

TRANSIENT = ("redaction_tokens", "raw")


def persistable(findings: DataFrame) -> DataFrame:
    """Findings without the columns that may hold secrets."""
    return findings.drop(*[c for c in TRANSIENT if c in findings.columns])


def sink_findings(findings: DataFrame, path: str, run_id: str, laid_out: bool = False) -> None:
    """Write the findings of one run.

    The run is a folder of its own, and only that folder is replaced: a repeated run never doubles its own rows, a
    run without rows leaves none, and those of other runs are not touched. The stored rows can be queried like any
    partitioned table. Rows of a scan go together; AQE splits a scan that is too large for one file and joins
    small ones. ``laid_out`` says that the rows lie like that already, as in a stored copy; they are not shuffled again.
    """
    rows = persistable(findings)
    if not laid_out:
        rows = rows.hint("rebalance", "scan_id").sortWithinPartitions("scan_id", "severity")
    _replace(rows, f"{path}/run_id={run_id}")


def _replace(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").format(fmt).save(folder)


def sink_report_tables(tables: dict[str, DataFrame], path: str, run_id: str, fmt: str = "parquet") -> None:
    """``report_meta``, ``report_summary``, ``report_blocks`` of one run below one folder, in any Spark format.

    Each table is partitioned by run; the reports of other runs stay.
    """
    for name, df in tables.items():
        _replace(df, f"{path}/{name}/run_id={run_id}", fmt)
