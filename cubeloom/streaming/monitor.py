"""Progress of running experiments: the same aggregates in batch and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The event table as executions: event_type is the configuration, created_at a timestamp with time zone."""
    shape = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if stream else spark.read.schema(shape).parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.col("event_type").alias("config"), F.col("user_id").cast("string").alias("query_id"), F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("created_at"))


def overall(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def by_config(rows: DataFrame) -> DataFrame:
    return rows.groupBy("config").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))


def daily(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mean by day and configuration; late rows are waited for as long as ``delay``."""
    waited = rows.withWatermark("created_at", delay) if rows.isStreaming else rows
    return waited.groupBy(F.window("created_at", "1 day").alias("w"), "config").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "config", "n", "avg_score")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a memory table, and return that."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def watch(stream: DataFrame, sink, seconds: int = 30):
    """Poll: ``sink(frame, batch_id)`` gets the refreshed aggregates every so many seconds."""
    return stream.writeStream.outputMode("complete").foreachBatch(sink).trigger(processingTime=f"{seconds} seconds").start()
