"""Tables of the queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.scores import effective_confidence
from lorespark.operators.copies import earliest_copy
from lorespark.session import table

#: The time that stands for now, so that results do not depend on the clock.
NOW = "2026-01-01 00:00:00"


def now():
    """``NOW`` as a Column."""
    return F.to_timestamp(F.lit(NOW))


def entries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Entries once each (earliest copy), with the columns named."""
    return earliest_copy(table(spark, sf_dir, "entries"), "id", {c: F.col(c) for c in columns if c != "id"})


def scored_entries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Entries with ``effective_confidence`` as of ``NOW``."""
    need = dict.fromkeys([*columns, "confidence", "decay_rate", "last_verified", "expires"])
    return entries(spark, sf_dir, *need).withColumn("effective_confidence", effective_confidence(now()))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures once each."""
    return earliest_copy(table(spark, sf_dir, "captures"), "id", {"input": F.col("input"), "captured_at": F.col("captured_at")})


E = "e AS (SELECT * FROM entries WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
C = "c AS (SELECT * FROM captures WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
#: Entries with effective confidence.
S = f"""{E}, s AS (SELECT *, CASE WHEN expires <= TIMESTAMPTZ '{NOW}+00' THEN 0.0 ELSE least(1.0, greatest(0.0, confidence * exp(-decay_rate * greatest(0, floor((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(last_verified)) / 1000000.0)) / 31557600.0))) END AS effective_confidence FROM e)"""
