"""Counts and roll-ups over findings and engine runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill import constants as K


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"))


def severity_summary(findings: DataFrame, keys: list[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Five zero-filled severity rows and a total per group; the total counts other severities too.

    ``groups`` holds the keys of all groups, also of those without findings, which get six zeros.
    """
    keys = keys or []
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITIES]
    wide = findings.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total"))
    names = [*K.SEVERITIES, "total"]
    if groups is not None:
        wide = groups.select(*keys).distinct().join(wide, keys, "left").fillna(0, names)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(n.capitalize()).alias("label"), F.col(n).alias("n"))
            for i, n in enumerate(names)
        ]
    )
    return wide.select(*keys, F.inline(rows))


def engine_state_counts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One column per engine state."""
    return runs.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s) for s in K.ENGINE_STATES])


def _count_map(pairs: dict[str, Column]) -> Column:
    """Map of the counts that are not zero, in the order given."""
    entries = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"] > 0))


def scan_summary(findings: DataFrame, runs: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """One nested row per scan: total, per severity, per engine state, languages.

    Severities and states are closed sets, so counting is a plain aggregation.
    """
    by_sev = findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(f"f_{s}") for s in K.SEVERITIES]
    )
    by_state = engine_state_counts(runs, ["scan_id"])
    out = by_state.join(by_sev, "scan_id", "full_outer")
    if languages is not None:
        out = out.join(languages, "scan_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "scan_id",
        F.coalesce("total", zero).alias("total"),
        _count_map({s: F.coalesce(f"f_{s}", zero) for s in K.SEVERITIES}).alias("by_severity"),
        _count_map({s: F.coalesce(s, zero) for s in K.ENGINE_STATES}).alias("engines"),
        *([F.col("languages")] if languages is not None else []),
    )


def scan_verdict(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``runs(scan_id, engine, state, kind)`` -> final status and message per scan."""
    keys = keys or ["scan_id"]
    flags = runs.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("kind").isin(*K.REAL_FAILURE_KINDS)), F.lit(False)).alias("_failed"),
        F.bool_or(F.col("state") == "done").alias("_done"),
    )
    failed, done = F.col("_failed"), F.col("_done")
    return flags.select(
        *keys,
        F.when(~failed & done, "succeeded").otherwise("failed").alias("status"),
        F.when(failed, K.VERDICT_ENGINE_FAILED)
        .when(~done, K.VERDICT_NONE_COMPLETED)
        .otherwise("")
        .alias("error"),
    )


def coverage_rollup(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Engines done and failed out of all, with the headline shown for the scan.

    ``runs`` carries ``scan_status`` beside the engine state.
    """
    keys = keys or ["scan_id"]
    state = F.col("state")
    agg = runs.groupBy(*keys).agg(
        F.count_if(state == "done").alias("done"),
        F.count_if(state.isin("failed", "timeout", "unavailable")).alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.max(F.col("scan_status")).alias("scan_status"),
    )
    return agg.withColumn(
        "headline",
        F.when(F.col("scan_status") == "failed", "Scan failed")
        .when(F.col("failed") > 0, "Scan completed with warnings")
        .otherwise("Scan completed"),
    )


def counts_per(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
