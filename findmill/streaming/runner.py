"""Running streams to files or to their state, and reading that state as a table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's with the state store the stateful streams use."""
    s = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        s.conf.set(key, spark.conf.get(key))
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Upload changes instead of whole snapshots, and do not look every key up to count it.
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    return s


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files ``name*.parquet`` of a folder."""
    schema = spark.read.option("pathGlobFilter", f"{name}*.parquet").parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def checkpoint(path: str) -> str:
    return os.path.join(path, "checkpoint")


def run_to_files(stream: DataFrame, path: str, trigger: dict | None = None, idle_batches: bool = True) -> str:
    """Append a stream to Parquet until its input is used up; returns the data folder.

    Without ``idle_batches`` there are no micro-batches without input. State that lives by processing time asks for
    one more each time, so that a run over what is there would not end.
    """
    out = os.path.join(path, "data")
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint(path))
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
    return out


def run_to_state(stream: DataFrame, path: str, trigger: dict | None = None) -> str:
    """Run a stream for its state alone, which holds one row per key whatever the number of micro-batches; returns the checkpoint folder."""
    query = (
        stream.writeStream.format("noop")
        .option("checkpointLocation", checkpoint(path))
        .outputMode("update")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
    return checkpoint(path)


def read_state(spark: SparkSession, checkpoint_folder: str, variable: str | None = None) -> DataFrame:
    """The state after the last committed micro-batch, with the key's columns beside the value's.

    ``variable`` names a state variable of a processor; an aggregation has none.
    """
    reader = stream_session(spark).read.format("statestore").option("path", checkpoint_folder)
    rows = (reader.option("stateVarName", variable) if variable else reader).load()
    value = "list_element" if "list_element" in rows.columns else "value"
    return rows.select("key.*", f"{value}.*")
