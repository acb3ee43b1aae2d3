"""Queries on texts: cut values, leaked evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.leakage import leaked_items, leaked_windows, without_leaks
from lorespark.llm.truncation import judged_values, truncation_rates
from lorespark.session import table


def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and responses of session turns and outcomes of captures, as values of a source and field."""
    turns = table(spark, sf_dir, "sessions").select("session_id", "source_agent", F.explode("turns").alias("turn"))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"turn.{f}").alias("text")) for f in ("prompt", "response")])
    of_turns = turns.select(F.lit("sessions").alias("source_table"), F.col("session_id").alias("record_id"), F.col("turn.id").alias("turn_id"), F.col("source_agent").alias("source"), F.inline(fields))
    captures = table(spark, sf_dir, "captures").select(
        F.lit("captures").alias("source_table"), F.col("id").alias("record_id"), F.lit("").alias("turn_id"), F.col("input.source_agent").alias("source"), F.lit("outcome").alias("field_name"), F.col("input.outcome").alias("text")
    )
    return of_turns.unionByName(captures)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, responses and outcomes that are not the whole text."""
    return judged_values(stored_values(spark, sf_dir)).where("cut").select("source_table", "record_id", "turn_id", "field_name")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut values per source agent and field."""
    return truncation_rates(judged_values(stored_values(spark, sf_dir)))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"), n=13)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 13 words in a row of an evaluation item, and the items they reveal."""
    return leaked_items(_hits(spark, sf_dir))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each suite and item that leaked, the number of documents that reveal it."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", "lang")
    return p6_found(spark, sf_dir).join(items, "item_id").groupBy("suite", "item_id", "lang").agg(F.count("*").alias("n_documents"))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaking documents with the leaked spans cut out."""
    return without_leaks(_hits(spark, sf_dir), n=13)


_WORDS = r"regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}]+')"
_FOUND = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM d WHERE len(w) >= 13),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p6_found": p6_found, "p6_items": p6_items, "p6_cleaned": p6_cleaned}
SQL = {
    "p6_found": _FOUND,
    "p6_items": f"SELECT suite, item_id, lang, count(*) AS n_documents FROM ({_FOUND}) JOIN eval_items USING (item_id) GROUP BY ALL",
}
