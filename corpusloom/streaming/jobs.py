"""Structured Streaming: windows by event time, change capture and state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.runtime import fresh_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table as a stream of its files (the table is a file or a folder of files)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # As a pattern the path may name a file, too.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything there is now through the stream into a written table, exactly once (checkpointed)."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, each) -> None:
    """each(rows, number) for every batch, restartable from its checkpoint."""
    state = fresh_path(stream.sparkSession, f"{name}-state")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def run_merged(stream: DataFrame, name: str, partial, merge) -> DataFrame:
    """merge over all that ``partial`` makes of the batches: whole in any order of the rows, as no row is late and nothing stays open.

    The part of a batch is written under its number, so a batch that is run again replaces its own.
    """
    spark, schema = stream.sparkSession, partial(stream).schema
    out = fresh_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(f"{out}/none")  # a stream without rows has no batch
    run_batches(stream, name, lambda rows, number: partial(rows).write.mode("overwrite").parquet(f"{out}/{number}"))
    return merge(spark.read.schema(schema).parquet(f"{out}/*"))


def windowed_counts(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(window_start, event_type, events, total) of tumbling windows, or with ``slide`` of sliding ones; in a stream that keeps state, rows
    later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def summed_counts(parts: DataFrame) -> DataFrame:
    """The windows of several ``windowed_counts`` as one."""
    return parts.groupBy("window_start", "event_type").agg(F.sum("events").alias("events"), F.sum("total").alias("total"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(user_id, session_start, session_end, events): a session ends after a gap without events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def last_states(stream: DataFrame, name: str) -> DataFrame:
    """What ``latest_state`` holds of every key when the stream has been read: each batch writes the keys it touched, the last counts."""
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, name)
    schema = "user_id long, last_ts timestamp, events long"
    spark.createDataFrame([], schema).write.parquet(f"{out}/none")

    def each(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{number}")

    updates = latest_state(stream).writeStream.outputMode("update").foreachBatch(each)
    updates.option("checkpointLocation", fresh_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    # A key's count only grows.
    written = spark.read.schema(schema).parquet(f"{out}/*")
    return written.groupBy("user_id").agg(F.max(F.struct("events", "last_ts")).alias("x")).select("user_id", "x.last_ts", "x.events")


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, last_ts, events) after each batch, kept as state: the last heartbeat of every key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        for pdf in batches:
            newest = pdf["ts"].max().to_pydatetime()
            last, n = (newest if last is None else max(last, newest)), n + len(pdf)
        state.update((last, n))
        yield pd.DataFrame({"user_id": [key[0]], "last_ts": [last], "events": [n]})

    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).where("user_id is not null and ts is not null")
    return timed.groupBy("user_id").applyInPandasWithState(update, "user_id long, last_ts timestamp, events long", "last_ts timestamp, n long", "update", GroupStateTimeout.NoTimeout)
