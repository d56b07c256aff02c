"""Structured Streaming forms of the event reports, beyond what batch jobs need. Each has a batch twin with equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.upsert import upsert_path


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as an instant (files may hold it without a zone), and on a stream the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed_totals(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and sums by window and event type; on a stream, state older than the watermark is dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = _timed(events, late)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's runs of events no further apart than the gap."""
    rows = _timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row per key; on a stream, keys are remembered for as long as the watermark allows."""
    rows = _timed(events, late)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def upsert_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A running query that upserts every micro-batch into a Parquet table, the last row of a key winning; done when the input is."""

    def apply(batch: DataFrame, _: int) -> None:
        upsert_path(batch.sparkSession, path, batch, keys, dedupe=True)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
