"""Windows over event streams, and an upsert sink for their results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """The events of a Parquet path (a file or a folder) as a stream; times without a zone are UTC in the session."""
    rows = parquet_stream(spark, path, files_at_once)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def parquet_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream. The source takes folders and patterns, so the path is made a pattern."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of tumbling or sliding windows; events later than ``late`` are dropped."""
    when = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(when.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events with less than ``gap`` between them."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_available(result: DataFrame, keys: list[str] | None = None, mode: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its result.

    With ``keys`` the stream runs in update mode: each micro-batch gives the rows that changed, state behind the watermark
    and rows later than it are dropped, and the result is the last row of each key (an upsert). Without, it runs in append
    mode (rows that are final once the watermark has passed; a micro-batch without data closes what it can) or in the
    ``mode`` given. Each micro-batch is written by the executors to the shared folder under its number, so a batch that
    runs again replaces itself.
    """
    mode = mode or ("update" if keys else "append")
    spark = result.sparkSession
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")
        last.append(number)

    result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}-state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    if mode == "complete":
        return spark.read.schema(result.schema).parquet(f"{place}/batch={max(last)}")
    rows = spark.read.schema(T.StructType([*result.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(place)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in result.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_r"))
    return newest.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in result.columns])
