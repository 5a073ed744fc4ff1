"""Streaming twins of the signal aggregates, on file sources, with the state in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_dir, written


def weekly(events: DataFrame) -> DataFrame:
    """Counts of each family and actor in weeks from 2024-01-01, for a batch or a stream of (ts, event_type, user_id)."""
    week = F.window(F.col("ts").cast("timestamp"), "7 days", startTime="4 days")  # 1970-01-05 was a Monday
    return events.groupBy(week.alias("w"), F.col("event_type").alias("family"), "user_id").agg(F.count("*").alias("n"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream: streams read folders or patterns, so this pattern matches the table's name alone."""
    parent, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{parent}/[{name[0]}]{name[1:]}")


def weekly_signals(spark: SparkSession, path: str) -> DataFrame:
    """Run the weekly aggregate over a file stream until what is there has been read; the result is the complete state.

    A stream cannot count distinct values, so its state has one small row for each week, family and actor, dealt over the
    cluster; the last step counts them. Late rows are merged, never dropped, so there is no watermark. The stream's own
    folder is removed when its result is written down.
    """
    stream = table_stream(spark, path)
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.to_date("w.start").alias("window_start"), "family").agg(F.sum("n").alias("n"), F.count("*").alias("actors"))
        counts.select(F.lit(7).alias("days"), "window_start", "family", "n", "actors").write.mode("overwrite").parquet(f"{folder}/state")

    run = weekly(stream).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    state = written(spark.read.parquet(f"{folder}/state"))
    remove(spark, folder)
    return state


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Exactly-once by key: replays within ``late`` of the newest event are dropped, and the state forgets older keys."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def touched(batch: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """The history of only those keys that a micro-batch brings, for an incremental re-aggregation."""
    return history.join(batch.select(*keys).distinct(), keys, "left_semi")
