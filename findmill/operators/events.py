"""Scan event buffers: sequence numbers, ring, cursor reads, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions.text import first_int
from findmill.operators.ordered import Running, with_running


def event_seq(events: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Sequence numbers 1, 2, ... per scan."""
    return with_running(events, ["scan_id"], order, chunk, {"seq": Running("count")})


def last_seq(sequenced: DataFrame) -> DataFrame:
    return sequenced.groupBy("scan_id").agg(F.max("seq").alias("last_seq"))


def event_ring(sequenced: DataFrame, size: int = K.EVENT_RING_SIZE) -> DataFrame:
    """The last ``size`` events of every scan. Numbers are dense, so a maximum decides; nothing is ranked."""
    out = sequenced.join(last_seq(sequenced), "scan_id")
    return out.where(F.col("seq") > F.col("last_seq") - size).drop("last_seq")


def events_since(sequenced: DataFrame, cursors: DataFrame, size: int = K.EVENT_RING_SIZE) -> DataFrame:
    """Retained events after each reader's cursor, with the last number ever given.

    ``cursors(scan_id, after_seq)``; scans without a cursor are not read.
    """
    ends = last_seq(sequenced).join(cursors, "scan_id")
    floor = F.greatest(F.col("after_seq"), F.col("last_seq") - size)
    return sequenced.join(ends, "scan_id").where(F.col("seq") > floor)


def latest_event(sequenced: DataFrame, columns: list[str]) -> DataFrame:
    top = F.max(F.struct("seq", *columns)).alias("t")
    return sequenced.groupBy("scan_id").agg(top).select("scan_id", *[F.col(f"t.{c}").alias(c) for c in ["seq", *columns]])


def progress_changes(polls: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Polls whose percentage differs from the one before; polling ends at the first 100.

    Unreadable percentages count as 0.
    """
    pct = F.coalesce(first_int("status"), F.lit(0).cast("long"))
    rows = polls.withColumn("pct", pct)
    end = F.when(F.col("pct") >= 100, F.struct(*order))
    first_end = rows.groupBy(*keys).agg(F.min(end).alias("_end"))
    live = rows.join(first_end, keys).where(F.col("_end").isNull() | (F.struct(*order) <= F.col("_end"))).drop("_end")
    marked = with_running(live, keys, order, chunk, {"_prev": Running("lag", F.col("pct"))})
    return marked.where(F.col("pct") != F.coalesce("_prev", F.lit(-1).cast("long"))).drop("_prev")
