"""Intermediate tables in the shared folder, and joins that broadcast only what was counted."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.session import ensure_checkpoint_dir

#: Rows that a side may have to be broadcast. Beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again: computed once, and an executor that
    is lost takes nothing with it. The files go when the session's process ends."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_drop)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows; else as it is, for a shuffled join."""
    count = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if count <= BROADCAST_ROWS else df
