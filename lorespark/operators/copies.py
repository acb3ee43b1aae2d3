"""Copies of a row: the same key delivered again with a later ``loaded_at``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest_copy(df: DataFrame, key: str, columns: dict[str, Column], loaded_at: str = "loaded_at") -> DataFrame:
    """One row per ``key`` with ``columns`` as the copy with the earliest ``loaded_at`` has them.

    Only the named columns are shuffled, after a map-side minimum, so a key with very many copies costs one row per
    task. Copies without ``loaded_at`` count as the latest; among equal times the smallest values win. Rows whose key
    is null are dropped. An empty table gives an empty table.
    """
    order = F.coalesce(F.col(loaded_at), F.lit("9999-12-31").cast("timestamp"))
    packed = F.struct(order.alias("_at"), *[c.alias(n) for n, c in columns.items()])
    kept = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(packed).alias("_row"))
    return kept.select(F.col("_key").alias(key), *[F.col("_row")[n].alias(n) for n in columns])
