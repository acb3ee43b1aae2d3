"""Schemas of the tables that sources produce."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A, _D, _T = T.StringType(), T.ArrayType(T.StringType()), T.DoubleType(), T.TimestampType()

#: An entry of a vault.
ENTRY = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("kind", _S),
        T.StructField("title", _S),
        T.StructField("status", _S),
        T.StructField("confidence", _D),
        T.StructField("tags", _A),
        T.StructField("source_agents", _A),
        T.StructField("created", _T),
        T.StructField("updated", _T),
        T.StructField("last_verified", _T),
        T.StructField("expires", _T),
        T.StructField("supersedes", _A),
        T.StructField("superseded_by", _S),
        T.StructField("links", _A),
        T.StructField("decay_rate", _D),
        T.StructField("body", _S),
    ]
)

#: An event as a host delivers it.
EVENT = T.StructType([T.StructField("type", _S), T.StructField("id", _S), T.StructField("cwd", _S), T.StructField("payload", _S), T.StructField("data", _S)])
