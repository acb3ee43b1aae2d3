"""Queries of tokens, vectors, keyword and hybrid retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.hashing import content_hash
from lorespark.functions.text import STOP_WORDS, tokens
from lorespark.operators import index as I
from lorespark.operators import keyword as K
from lorespark.operators import vectors as V
from lorespark.queries.base import E, entries
from lorespark.session import cut_lineage, ensure_checkpoint_dir, table

DIMENSIONS = 8192
QUERY = "stale lock in the nightly run"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text of entries as retrieval sees them: the title twice, tags, body."""
    e = entries(spark, sf_dir, "title", "tags", "body")
    return e.select("id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("title", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), F.coalesce("body", F.lit(""))).alias("text"))


def _space(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Term counts, vocabulary, packed vectors and number of the entries, computed once each."""
    t = cut_lineage(texts(spark, sf_dir))
    n = t.count()
    counts = cut_lineage(V.term_counts(t))
    vocab = cut_lineage(V.vocabulary(counts, DIMENSIONS))
    return counts, vocab, V.packed_vectors(counts, vocab, n), n


def _long(packed: DataFrame) -> DataFrame:
    return packed.select("id", F.inline(F.arrays_zip(F.col("dims").alias("dim"), F.col("weights").alias("weight"))))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the entries for keyword search, written once."""
    return cut_lineage(K.keyword_documents(_documents(spark, sf_dir), ["title", "body", "tags"]))


def entry_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir, "title").select("id", F.posexplode(tokens(F.col("title"))).alias("place", "token"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.term_counts(texts(spark, sf_dir))


def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.term_counts(texts(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("df"))


def hashed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vocabulary(V.term_counts(texts(spark, sf_dir)), DIMENSIONS).select("token", "dim", "sign")


def dimension_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dimension_terms(V.vocabulary(V.term_counts(texts(spark, sf_dir)), DIMENSIONS)).select("dim", F.array_join("terms", "|").alias("terms"))


def entry_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_space(spark, sf_dir)[2]).select("id", "dim", F.round("weight", 6).alias("weight"))


def asked(vectors: DataFrame) -> DataFrame:
    """The query set: entries whose id is a number divisible by 20."""
    number = F.conv(F.substring("id", 5, 12), 16, 10).cast("bigint")
    return vectors.where(F.col("id").rlike("^mem-[0-9a-f]{12}$") & (number % 20 == 0))


def neighbours(spark: SparkSession, sf_dir: str, k: int = 8, least: float = 0.08) -> DataFrame:
    """Nearest entries of the query set against all rows."""
    packed = cut_lineage(_space(spark, sf_dir)[2])
    return V.nearest(asked(packed), packed, k, least, DIMENSIONS)


def nearest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def explained_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vocab, packed, _ = _space(spark, sf_dir)
    packed = cut_lineage(packed)
    vectors = _long(packed)
    near = V.nearest(asked(packed), packed, 3, 0.08, DIMENSIONS).select(F.col("query_id").alias("id_a"), F.col("id").alias("id_b"))
    return V.shared_terms(near, vectors, V.dimension_terms(vocab)).select("id_a", "id_b", F.array_join("terms", ", ").alias("terms"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir, "title", "body", "tags").withColumn("tags", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))


def _ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")))  # of a short list


def bm25_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bm25(_indexed(spark, sf_dir), QUERY).select("id", F.round("score", 6).alias("score"))


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bm25(_indexed(spark, sf_dir), "stale lock", every=True).select("id", F.round("score", 6).alias("score"))


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(K.bm25(_indexed(spark, sf_dir), QUERY, k=20)).select("id", "rank")


def semantic_search(spark: SparkSession, sf_dir: str, query: str = QUERY, k: int = 40) -> DataFrame:
    """The rows most similar to a free text, unknown tokens dropped."""
    _, vocab, packed, n = _space(spark, sf_dir)
    return _near_text(spark, vocab, packed, n, query, k)


def _near_text(spark: SparkSession, vocab: DataFrame, packed: DataFrame, n: int, query: str, k: int) -> DataFrame:
    words = V.term_counts(spark.createDataFrame([("?", query)], "id string, text string"))
    return V.nearest(V.packed_vectors(words, vocab, n), packed, k, 0.02, DIMENSIONS).select("id", "similarity", "rank")


def _index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of the entries, built in the shared folder."""
    e = cut_lineage(entries(spark, sf_dir, "title", "tags", "body"))
    return I.build_index(e, f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}", DIMENSIONS, "of one query")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    keyword = _ranked(K.bm25(index.documents, QUERY, k=40))
    return K.fuse(keyword, _near_text(spark, index.vocabulary, index.packed, index.n, QUERY, 40), 10).select("id", F.round("score", 6).alias("score"), "first_rank", "second_rank")


def dense_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("int")).alias("dims"), F.transform("embedding", lambda x: x.cast("double")).alias("weights"))
    return V.nearest(rows.where("id % 20 = 0"), rows, 10, -1.0, 64).select("query_id", "id", "rank")


def entry_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir, "kind", "title", "status", "confidence", "body", "tags")
    return e.select("id", content_hash(F.array("id", "kind", "title", "status", "body", F.array_join("tags", "\x1f")), F.col("confidence")).alias("content_hash"))


QUERIES = {
    "entry_tokens": entry_tokens,
    "document_tokens": document_tokens,
    "term_counts": term_counts,
    "token_df": token_df,
    "hashed_tokens": hashed_tokens,
    "dimension_terms": dimension_terms,
    "entry_vectors": entry_vectors,
    "nearest_entries": nearest_entries,
    "explained_neighbours": explained_neighbours,
    "bm25_any": bm25_any,
    "bm25_all": bm25_all,
    "bm25_top": bm25_top,
    "hybrid_search": hybrid_search,
    "dense_neighbours": dense_neighbours,
    "entry_fingerprints": entry_fingerprints,
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _token_sql(source: str, place: bool = False) -> str:
    """CTEs that end in ``tok(id, token)``, from a relation with id and text."""
    script = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
    return f"""
run AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[{script}]+')) AS r, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+|[{script}]+'), 1) AS k FROM {source}),
folded AS (SELECT id, k, r, CASE WHEN length(r) >= 4 AND regexp_full_match(r, '[a-z]+') THEN
  CASE WHEN r LIKE '%ies' THEN CASE WHEN length(r) - 2 >= 3 THEN left(r, length(r) - 3) || 'y' ELSE r END WHEN r LIKE '%ss' THEN r WHEN r LIKE '%s' THEN left(r, length(r) - 1) ELSE r END ELSE r END AS f FROM run),
tok AS (SELECT id, k, f AS token, 0 AS u FROM folded WHERE regexp_matches(r, '^[a-z0-9]') AND NOT (length(r) < 2 AND NOT regexp_full_match(r, '[0-9]')) AND f NOT IN ({_STOP})
  UNION ALL SELECT id, k, unnest(list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))), generate_subscripts(range(1, 2 * length(r)), 1) FROM folded WHERE NOT regexp_matches(r, '^[a-z0-9]'))"""


_TEXTS = "x AS (SELECT id, coalesce(title, '') || chr(10) || coalesce(title, '') || chr(10) || coalesce(array_to_string(tags, ' '), '') || chr(10) || coalesce(body, '') AS text FROM e)"
_COUNTS = f"{E}, {_TEXTS}, {_token_sql('x')}, tc AS (SELECT id, token, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tc GROUP BY token)"
_M = "18446744073709551616"
_SHIFT = lambda v, n: f"({v} // {2**n}::UHUGEINT)"
_HASHED = f"""h1 AS (SELECT token, df, list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(0, length(hex(encode(token))) // 2), lambda i: ('0x' || substring(hex(encode(token)), 2 * i + 1, 2))::UHUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % {_M}::UHUGEINT) AS h FROM df),
h2 AS (SELECT *, (h + 11400714819323198485::UHUGEINT) % {_M}::UHUGEINT AS a FROM h1),
h3 AS (SELECT *, (xor(a, {_SHIFT('a', 30)}) * 13787848793156543929::UHUGEINT) % {_M}::UHUGEINT AS b FROM h2),
h4 AS (SELECT *, (xor(b, {_SHIFT('b', 27)}) * 10723151780598845931::UHUGEINT) % {_M}::UHUGEINT AS c FROM h3),
vocab AS (SELECT token, df, (h % 8192::UHUGEINT)::INT AS dim, CASE WHEN xor(c, {_SHIFT('c', 31)}) % 2::UHUGEINT = 1 THEN 1 ELSE -1 END AS sign FROM h4)"""
_VECTORS = f"""{_COUNTS}, {_HASHED}, nd AS (SELECT count(*) AS n FROM e),
raw AS (SELECT id, dim, sum(sign * (1 + ln(tf)) * ln(1 + (n - df + 0.5) / (df + 0.5))) AS w FROM tc JOIN vocab USING (token), nd GROUP BY id, dim HAVING abs(w) >= 1e-4),
vec AS (SELECT id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""
_NEAR = f"""{_VECTORS}, q AS (SELECT * FROM vec WHERE regexp_full_match(id, 'mem-[0-9a-f]{{12}}') AND ('0x' || substring(id, 5, 12))::BIGINT % 20 = 0),
sim AS (SELECT q.id AS query_id, v.id, sum(q.w * v.w) AS similarity FROM q JOIN vec v ON q.dim = v.dim AND q.id <> v.id GROUP BY ALL HAVING sum(q.w * v.w) > 0.08),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sim QUALIFY rank <= 8)"""


def _bm25_sql(terms: list[str], every: bool) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{E}, w AS (SELECT id, regexp_extract_all(lower(strip_accents(coalesce(title, '') || ' ' || coalesce(body, '') || ' ' || coalesce(array_to_string(tags, ' '), ''))), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS w FROM e),
st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w), p AS (SELECT id, len(w) AS l, unnest(w) AS t FROM w), f AS (SELECT id, l, t, count(*) AS f FROM p WHERE t IN ({listed}) GROUP BY ALL),
d AS (SELECT t, count(*) AS df FROM f GROUP BY t),
b AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / m))) AS score FROM f JOIN d USING (t), st GROUP BY id {f'HAVING count(*) = {len(terms)}' if every else ''})"""


#: The vectors again, with the free text of the search as a row of its own that does not count for the vocabulary.
_ASKED = _VECTORS.replace("AS text FROM e)", f"AS text FROM e UNION ALL SELECT '?', '{QUERY}')", 1).replace("AS df FROM tc GROUP", "AS df FROM tc WHERE id <> '?' GROUP", 1)
_TERMS = [t for t, _ in K.query_terms(QUERY)]
SQL = {
    "entry_tokens": f"WITH {E}, x AS (SELECT id, title AS text FROM e), {_token_sql('x')} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k, u) - 1)::INT AS place, token FROM tok",
    "document_tokens": f"WITH x AS (SELECT doc_id AS id, text FROM documents), {_token_sql('x')} SELECT token, count(*) AS n FROM tok GROUP BY token",
    "term_counts": f"WITH {_COUNTS} SELECT id, token, tf FROM tc",
    "token_df": f"WITH {_COUNTS} SELECT token, df FROM df",
    "hashed_tokens": f"WITH {_COUNTS}, {_HASHED} SELECT token, dim, sign FROM vocab",
    "dimension_terms": f"WITH {_COUNTS}, {_HASHED}, r AS (SELECT dim, token, row_number() OVER (PARTITION BY dim ORDER BY df DESC, token) AS r FROM vocab) SELECT dim, string_agg(token, '|' ORDER BY r) AS terms FROM r WHERE r <= 3 GROUP BY dim",
    "entry_vectors": f"WITH {_VECTORS} SELECT id, dim, round(w, 6) AS weight FROM vec",
    "nearest_entries": f"WITH {_NEAR} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM near",
    "bm25_any": f"WITH {_bm25_sql(_TERMS, False)} SELECT id, round(score, 6) AS score FROM b",
    "bm25_all": f"WITH {_bm25_sql(['stale', 'lock'], True)} SELECT id, round(score, 6) AS score FROM b",
    "bm25_top": f"WITH {_bm25_sql(_TERMS, False)} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 20",
    "hybrid_search": f"""WITH {_ASKED}, {_bm25_sql(_TERMS, False).removeprefix(E + ',')},
kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 40),
sv AS (SELECT v.id, row_number() OVER (ORDER BY sum(q.w * v.w) DESC, v.id) AS rank FROM vec q JOIN vec v ON q.id = '?' AND v.id <> '?' AND q.dim = v.dim GROUP BY v.id HAVING sum(q.w * v.w) > 0.02 QUALIFY rank <= 40)
SELECT id, round(coalesce(1 / (60 + kw.rank), 0) + coalesce(1 / (60 + sv.rank), 0), 6) AS score, kw.rank AS first_rank, sv.rank AS second_rank FROM kw FULL JOIN sv USING (id) ORDER BY coalesce(1 / (60 + kw.rank), 0) + coalesce(1 / (60 + sv.rank), 0) DESC, id LIMIT 10""",
    "explained_neighbours": f"""WITH {_NEAR}, dt AS (SELECT dim, arg_min(token, (-df, token)) AS t FROM vocab GROUP BY dim),
sh AS (SELECT query_id AS id_a, n.id AS id_b, t, row_number() OVER (PARTITION BY query_id, n.id ORDER BY abs(a.w * b.w) DESC, t) AS r FROM near n JOIN vec a ON a.id = query_id JOIN vec b ON b.id = n.id AND b.dim = a.dim JOIN dt ON dt.dim = a.dim WHERE n.rank <= 3)
SELECT id_a, id_b, string_agg(t, ', ' ORDER BY r) AS terms FROM sh WHERE r <= 4 GROUP BY ALL""",
    "dense_neighbours": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= 10""",
}
