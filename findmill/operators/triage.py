"""Triage of findings: status changes, audit trail, current status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.operators.ordered import Running, with_running


def triage_apply(changes: DataFrame, chunk: Column, initial: DataFrame | None = None) -> DataFrame:
    """Audit rows of ``changes(finding_id, seq, to_status, reason)``.

    Unknown statuses are rejected. A change to the status a finding already has leaves no
    trace. ``initial(finding_id, status)`` gives starting statuses other than ``new``.
    """
    valid = changes.where(F.col("to_status").isin(*K.FINDING_STATUSES))
    steps = with_running(valid, ["finding_id"], ["seq"], chunk, {"_prev": Running("lag", F.col("to_status"))})
    start: Column = F.lit("new")
    if initial is not None:
        steps = steps.join(initial.select("finding_id", F.col("status").alias("_init")), "finding_id", "left")
        start = F.coalesce("_init", F.lit("new"))
    out = steps.withColumn("from_status", F.coalesce("_prev", start)).where("from_status <> to_status")
    return out.drop("_prev", "_init")


def triage_rejected(changes: DataFrame) -> DataFrame:
    return changes.where(~F.coalesce(F.col("to_status").isin(*K.FINDING_STATUSES), F.lit(False)))


def triage_current(audit: DataFrame) -> DataFrame:
    """Latest effective status and its reason."""
    latest = F.max(F.struct("seq", "to_status", "reason")).alias("l")
    return audit.groupBy("finding_id").agg(latest).select(
        "finding_id", F.col("l.to_status").alias("status"), F.col("l.reason").alias("triage_reason"), F.col("l.seq").alias("seq")
    )


def audit_trail(audit: DataFrame, finding_id: int | None = None) -> DataFrame:
    """Audit rows, newest first."""
    out = audit if finding_id is None else audit.where(F.col("finding_id") == finding_id)
    return out.orderBy(F.col("seq").desc())
