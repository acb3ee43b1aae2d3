"""Queries on pairs of records: near-duplicate texts and similar sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.near_duplicates import near_duplicate_pairs
from lorespark.llm.set_joins import similar_set_pairs
from lorespark.session import table


def saved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, id, text of entries (title, line break, body) and captures (outcome)."""
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    entries = table(spark, sf_dir, "entries").select(F.lit("entries").alias("source_table"), "id", F.concat(title, F.lit("\n"), body).alias("text"))
    captures = table(spark, sf_dir, "captures").select(F.lit("captures").alias("source_table"), "id", F.col("input.outcome").alias("text"))
    return entries.unionByName(captures)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries and of captures that say nearly the same: word triples, similarity 0.6."""
    return near_duplicate_pairs(saved_texts(spark, sf_dir), threshold=0.6, n=3)


def value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, id, values of entries: tags trimmed and lower-cased, links trimmed; null and blank ones dropped."""
    entries = table(spark, sf_dir, "entries")

    def clean(values, lower: bool):
        bare = F.transform(values, lambda v: F.regexp_replace(F.lower(v) if lower else v, r"(?U)^\s+|(?<!\s)\s+$", ""))
        return F.filter(bare, lambda v: v.isNotNull() & (F.length(v) > 0))

    tags = entries.select(F.lit("tags").alias("field_name"), "id", clean(F.col("tags"), True).alias("values"))
    return tags.unionByName(entries.select(F.lit("links").alias("field_name"), "id", clean(F.col("links"), False).alias("values")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries whose tag sets or link sets (3 values or more) have a similarity of 0.6."""
    return similar_set_pairs(value_sets(spark, sf_dir), threshold=0.6, least_values=3)


_WORDS = r"regexp_extract_all(regexp_replace(lower({}), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"

QUERIES = {"p2_found": p2_found, "p3_found": p3_found}
SQL = {
    "p2_found": f"""
WITH t AS (SELECT DISTINCT 'entries' AS source_table, id, coalesce(title, '') || chr(10) || coalesce(body, '') AS text FROM entries
           UNION SELECT DISTINCT 'captures', id, input.outcome FROM captures WHERE input.outcome IS NOT NULL),
w AS (SELECT source_table, id, {_WORDS.format('text')} AS w FROM t),
g AS (SELECT DISTINCT source_table, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3),
n AS (SELECT source_table, id, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT a.source_table, a.id AS id_a, b.id AS id_b, count(*) AS shared FROM g a JOIN g b ON a.source_table = b.source_table AND a.gram = b.gram AND a.id < b.id GROUP BY ALL)
SELECT s.source_table, id_a, id_b FROM s JOIN n x ON x.source_table = s.source_table AND x.id = id_a JOIN n y ON y.source_table = s.source_table AND y.id = id_b
WHERE shared >= 0.6 * (x.n + y.n - shared) - 1e-9""",
    "p3_found": r"""
WITH raw AS (SELECT DISTINCT 'tags' AS field_name, id, lower(unnest(tags)) AS v FROM entries UNION SELECT DISTINCT 'links', id, unnest(links) FROM entries),
v AS (SELECT DISTINCT field_name, id, regexp_replace(v, '^\s+|\s+$', '', 'g') AS v FROM raw WHERE regexp_replace(v, '^\s+|\s+$', '', 'g') <> ''),
n AS (SELECT field_name, id, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT a.field_name, a.id AS id_a, b.id AS id_b, count(*) AS shared FROM v a JOIN v b ON a.field_name = b.field_name AND a.v = b.v AND a.id < b.id GROUP BY ALL)
SELECT s.field_name, id_a, id_b FROM s JOIN n x ON x.field_name = s.field_name AND x.id = id_a JOIN n y ON y.field_name = s.field_name AND y.id = id_b
WHERE shared >= 0.6 * (x.n + y.n - shared) - 1e-9""",
}
