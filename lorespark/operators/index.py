"""The retrieval index of a vault: tokens, vocabulary and vectors as Parquet, with the settings they were made with.

An index is good for the entries and settings it was built from: it holds its version, its dimensions and a fingerprint of
the indexed columns. Where one of them differs, or a part cannot be read, :func:`open_index` gives None and the index is
built again. Keyword search, semantic search and the graph share it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import vectors
from lorespark.operators.keyword import keyword_documents
from lorespark.operators.maintain import fingerprint

#: Changes whenever the parts of an index or how they are made change.
VERSION = 2


@dataclass(frozen=True)
class Index:
    """``documents`` (id, length, tokens), ``counts`` (id, token, tf), ``vocabulary`` (token, df, dim, sign), ``packed`` (id,
    dims, weights) and the number of entries."""

    documents: DataFrame
    counts: DataFrame
    vocabulary: DataFrame
    packed: DataFrame
    n: int


def indexed_columns(entries: DataFrame) -> DataFrame:
    """id, title, tags (joined), body of entries, and ``text``, as vectors see them: the title twice, tags, body."""
    blank = F.lit("")
    title, body = F.coalesce("title", blank), F.coalesce("body", blank)
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    return entries.select("id", title.alias("title"), tags.alias("tags"), body.alias("body"), F.concat_ws("\n", title, title, tags, body).alias("text"))


def mark(entries: DataFrame) -> str:
    """A fingerprint of what an index of ``entries`` would hold."""
    row = fingerprint(indexed_columns(entries), "id", "text").first()
    return f"{row['n']}-{row['mark']}"


def build_index(entries: DataFrame, folder: str, dimensions: int = 8192, known_mark: str | None = None) -> Index:
    """Write the index of ``entries`` (id, title, tags, body; one row each) to ``folder`` and open it.

    The settings are written last, so a build that was broken off is not taken for an index.
    """
    spark = entries.sparkSession
    settings = known_mark or mark(entries)  # a caller that keeps no index need not take the fingerprint
    texts = indexed_columns(entries)
    keyword_documents(texts, ["title", "body", "tags"]).write.mode("overwrite").parquet(f"{folder}/documents")
    vectors.term_counts(texts.select("id", "text")).write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    n = spark.read.parquet(f"{folder}/documents").count()
    vectors.vocabulary(counts, dimensions).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    vectors.packed_vectors(counts, spark.read.parquet(f"{folder}/vocabulary"), n).write.mode("overwrite").parquet(f"{folder}/vectors")
    spark.createDataFrame([(VERSION, dimensions, settings, n)], "version int, dimensions int, mark string, n bigint").write.mode("overwrite").parquet(f"{folder}/settings")
    return _opened(spark, folder, n)


def open_index(spark: SparkSession, folder: str, mark_: str, dimensions: int = 8192) -> Index | None:
    """The index in ``folder`` if it has this version, these dimensions and this mark; else None."""
    try:
        row = spark.read.parquet(f"{folder}/settings").first()
        if row is None or (row["version"], row["dimensions"], row["mark"]) != (VERSION, dimensions, mark_):
            return None
        return _opened(spark, folder, row["n"])
    except AnalysisException:  # a part is not there
        return None


def _opened(spark: SparkSession, folder: str, n: int) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{part}") for part in ("documents", "counts", "vocabulary", "vectors")), n)


def ensured_index(entries: DataFrame, folder: str, dimensions: int = 8192) -> Index:
    """The index of ``entries`` in ``folder``, built if there is none that fits."""
    own = mark(entries)
    return open_index(entries.sparkSession, folder, own, dimensions) or build_index(entries, folder, dimensions, own)
