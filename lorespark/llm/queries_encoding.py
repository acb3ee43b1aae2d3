"""Queries on garbled text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.encodings import garbled_documents, lexicon, lost_words, mappings, twins
from lorespark.llm.staging import staged
from lorespark.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stretch of text that was decoded with a wrong encoding."""
    return garbled_documents(table(spark, sf_dir, "documents")).distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their text restored as far as the learned pairs of encodings can."""
    return garbled_documents(table(spark, sf_dir, "documents"), restore=True)


def p8_lost_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with lost characters and their most common clean twin."""
    return lost_words(p8_restored(spark, sf_dir), staged(lexicon(table(spark, sf_dir, "documents"))))


def p8_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled words with the clean twins that explain them."""
    return twins(staged(lexicon(table(spark, sf_dir, "documents"))))


def p8_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of encodings that alignment with clean twins shows, with the aligned words each accounts for."""
    found = mappings(twins(staged(lexicon(table(spark, sf_dir, "documents")))))
    return spark.createDataFrame(found, "read_as string, written_as string, n_words bigint")


def p8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How garbled documents were found: by a learned mapping, by lost characters alone, or both."""
    rows = p8_restored(spark, sf_dir)
    return rows.groupBy(F.col("turned").alias("by_mapping"), (F.col("n_lost") > 0).alias("has_lost")).agg(F.count("*").alias("n_documents"))


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored, "p8_lost_words": p8_lost_words, "p8_twins": p8_twins, "p8_mappings": p8_mappings, "p8_evidence": p8_evidence}
SQL: dict = {}
