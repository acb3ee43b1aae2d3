"""The capture queue as a stream: repeated deliveries and conflicts by event key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.streaming.windows import parquet_stream


def capture_stream(spark: SparkSession, path: str) -> DataFrame:
    """Captures of a Parquet path as a stream."""
    return parquet_stream(spark, path)


def deliveries(captures: DataFrame) -> DataFrame:
    """Per event key (agent, project, session, event): deliveries, the first time, and whether contents differ.

    The state of a key is four numbers, whatever the number of deliveries: contents are compared by their least and
    greatest hash.
    """
    content = F.xxhash64("input.title", "input.context", "input.action", "input.outcome")
    keyed = captures.select(F.lower(F.trim("input.source_agent")).alias("source_agent"), "input.project", "input.session_id", "input.event_id", "captured_at", content.alias("_h"))
    state = keyed.groupBy("source_agent", "project", "session_id", "event_id").agg(F.count("*").alias("n"), F.min("captured_at").alias("first_at"), F.min("_h").alias("_low"), F.max("_h").alias("_high"))
    return state.select("source_agent", "project", "session_id", "event_id", "n", "first_at", (F.col("_low") != F.col("_high")).alias("conflict"))
