"""Queries on mixtures of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm.mixing import mixture, mixture_shares
from lorespark.session import table


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their repeats."""
    return mixture(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return mixture_shares(p7_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict = {}
