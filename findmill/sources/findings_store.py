"""Stored findings that triage changes: copy on write by bucket, with a manifest that says which files count.

Findings lie in buckets of their id. A merge reads and rewrites the buckets that hold a changed finding, below a
folder of its own, and then writes a new manifest: one small file, so readers see all of a merge or nothing of it.
Files of other buckets stay as they are. A merge that was cut off leaves files that no manifest names; its
repetition writes them anew. One that came through is recognised by its name and does nothing again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256
_MANIFEST = "n long, buckets long, bucket long, version string, run string, schema string"


def _bucketed(findings: DataFrame, buckets: int) -> DataFrame:
    return findings.withColumn("_bucket", F.pmod(F.xxhash64("finding_id"), F.lit(buckets)))


def _write(findings: DataFrame, path: str, version: str) -> list[int]:
    """Write buckets below a version; the numbers of those that have rows."""
    folder = f"{path}/files/version={version}"
    # a bucket that is too large for one task is split, so none has to be sorted on disk
    dealt = findings.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "scan_id", "severity")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(folder)
    # at most one row per bucket
    return sorted(r[0] for r in _files(findings.sparkSession, path, findings.schema, [folder]).select("_bucket").distinct().collect())


def _files(spark: SparkSession, path: str, schema: StructType, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{path}/files").parquet(*folders)


def _publish(spark: SparkSession, path: str, n: int, buckets: int, held: dict[int, str], run: str, schema: StructType) -> None:
    rows = [(n, buckets, b, version, run, schema.json()) for b, version in sorted(held.items())] or [(n, buckets, None, None, run, schema.json())]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/manifest/at={n}")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _latest(spark: SparkSession, path: str) -> tuple[int, int, dict[int, str], StructType]:
    every = _manifests(spark, path)
    n = every.agg(F.max("n")).first()[0]
    rows = every.where(F.col("n") == n).collect()  # a row per bucket
    return n, rows[0].buckets, {r.bucket: r.version for r in rows if r.bucket is not None}, StructType.fromJson(json.loads(rows[0].schema))


def create_findings(findings: DataFrame, path: str, run: str, buckets: int = BUCKETS) -> None:
    """Store findings (``schemas.FINDING``) as the first state of a table."""
    dealt = _bucketed(findings, buckets)
    _publish(findings.sparkSession, path, 0, buckets, dict.fromkeys(_write(dealt, path, run), run), run, dealt.schema)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings as of the last merge."""
    _, _, held, schema = _latest(spark, path)
    return _read(spark, path, held, schema).drop("_bucket")


def _read(spark: SparkSession, path: str, held: dict[int, str], schema: StructType) -> DataFrame:
    folders = [f"{path}/files/version={version}/_bucket={b}" for b, version in sorted(held.items())]
    return _files(spark, path, schema, folders) if folders else spark.createDataFrame([], schema)


def _kept(changes: DataFrame, folder: str) -> DataFrame:
    """Changes are read three times, and are often the result of a long job."""
    changes.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
    return changes.sparkSession.read.schema(changes.schema).parquet(folder)


def merge_triage(spark: SparkSession, path: str, current: DataFrame, run: str) -> int:
    """Put ``current(finding_id, status, triage_reason)`` (``triage_current``) into the table; returns how many buckets were rewritten.

    Findings that the table lacks are ignored. ``run`` names the merge: a second call with the same name changes nothing.
    """
    if not _manifests(spark, path).where(F.col("run") == run).isEmpty():
        return 0
    n, buckets, held, schema = _latest(spark, path)
    change = _kept(current.select("finding_id", F.col("status").alias("_status"), F.col("triage_reason").alias("_reason")), f"{path}/changes/run={run}")
    touched = {r[0] for r in _bucketed(change, buckets).select("_bucket").distinct().collect()}  # at most ``buckets``
    touched &= set(held)
    if touched:
        # of these, the buckets that hold a finding that really changes: a look at four columns
        same = F.col("_status").eqNullSafe(F.col("status")) & F.col("_reason").eqNullSafe(F.col("triage_reason"))
        looked = _read(spark, path, {b: held[b] for b in touched}, schema).select("finding_id", "status", "triage_reason", "_bucket")
        touched = {int(r[0]) for r in looked.join(change, "finding_id").where(~same).select("_bucket").distinct().collect()}
    if touched:
        old = _read(spark, path, {b: held[b] for b in touched}, schema)
        new = old.join(change, "finding_id", "left").withColumns({
            "triage_reason": F.when(F.col("_status").isNotNull(), F.col("_reason")).otherwise(F.col("triage_reason")),
            "status": F.coalesce("_status", "status"),
        })
        _write(new.select(*old.columns), path, run)
    _publish(spark, path, n + 1, buckets, held | dict.fromkeys(touched, run), run, schema)
    return len(touched)
