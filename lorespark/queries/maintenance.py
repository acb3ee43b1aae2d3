"""Queries of vault maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import keyword as K
from lorespark.operators import maintain as M
from lorespark.operators.copies import earliest_copy
from lorespark.operators.curate import EVIDENCE
from lorespark.queries.base import C, E, captures, entries, now
from lorespark.queries.retrieval import _bm25_sql, _indexed, _ranked
from lorespark.session import table

PROMPT = "why did the flush of the index fail"
TERMS = [t for t, _ in K.query_terms(PROMPT)]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earliest_copy(table(spark, sf_dir, "queue_items"), "id", {c: F.col(c) for c in ("candidate", "review", "entry_id", "updated_at")})


def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = _items(spark, sf_dir).where("candidate.knowledge is not null").select(F.col("id").alias("draft_id"), "candidate.knowledge.*")
    return M.import_plan(drafts, entries(spark, sf_dir, "title", "kind", "confidence"))


def patched_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = _items(spark, sf_dir).where("entry_id is not null and review.knowledge is not null").select(F.col("entry_id").alias("id"), F.col("updated_at").alias("at"), "review.knowledge.title", "review.knowledge.kind", "review.knowledge.confidence")
    out = M.patched(entries(spark, sf_dir, "title", "kind", "confidence", "last_verified"), patches)
    return out.select("id", "title", "kind", "confidence", F.unix_micros("last_verified").alias("last_verified"))


def entry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.versions(entries(spark, sf_dir, "supersedes", "superseded_by"))


def queue_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures and queue items that lack the other, by id and the entry a review made of them."""
    made = _items(spark, sf_dir).select("id", "entry_id")
    return M.difference(captures(spark, sf_dir).select("id", F.lit(None).cast("string").alias("entry_id")), made)


def created_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the candidates of the queue would make."""
    drafts = _items(spark, sf_dir).where("candidate.knowledge is not null").select("candidate.knowledge.*", F.lit("queue").alias("source_agent"))
    return M.created(drafts, now()).select("id", "kind", "title", "confidence", F.length("body").alias("body_chars"), "path")


def superseded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after every version that one side declares has been declared by both."""
    e = entries(spark, sf_dir, "status", "supersedes", "superseded_by", "links", "updated")
    pairs = M.versions(e).select("old_id", "new_id")
    out = M.superseded(e, pairs, now())
    return out.select("id", "status", "superseded_by", F.size("supersedes").alias("n_supersedes"), F.size("links").alias("n_links"), F.unix_micros("updated").alias("updated"))


def vault_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fingerprint(entries(spark, sf_dir, "kind", "title", "status", "body"), "id", "kind", "title", "status", "body")


def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.looked_up(_items(spark, sf_dir).select("id", F.col("candidate.related_entries").alias("ids")), entries(spark, sf_dir, "title", "body"))


def entry_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reviewed(entries(spark, sf_dir, "body", "tags"))


def keyword_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir, "body").select("id", M.snippet(F.col("body"), ["flush"]).alias("snippet")).where("snippet is not null")


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked(K.bm25(_indexed(spark, sf_dir), PROMPT, k=8)).select("id", "rank")
    return M.prompt_context(hits, entries(spark, sf_dir, "status", "title", "body"))


QUERIES = {f.__name__: f for f in (created_entries, superseded_entries, import_plan, patched_entries, entry_versions, queue_difference, vault_fingerprint, candidate_lookup, entry_review, keyword_snippets, prompt_context)}

_I = "i AS (SELECT * FROM queue_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_FLAT = "trim(regexp_replace(regexp_replace(body, '^\\s*#[^\\n]*', ''), '\\s+', ' ', 'g'))"
SQL = {
    "import_plan": f"""WITH {E}, {_I}, h AS (SELECT lower(trim(title)) AS k, arg_min(id, id) AS id, arg_min(kind, id) AS kind, arg_min(confidence, id) AS confidence FROM e GROUP BY 1), d AS (SELECT id AS draft_id, candidate.knowledge AS x FROM i WHERE candidate.knowledge IS NOT NULL)
SELECT draft_id, h.id AS entry_id, CASE WHEN trim(coalesce(x.title, '')) = '' OR trim(coalesce(x.content, '')) = '' THEN 'invalid' WHEN h.id IS NULL THEN 'create' WHEN x.kind IS NOT DISTINCT FROM h.kind AND x.confidence IS NOT DISTINCT FROM h.confidence THEN 'unchanged' ELSE 'update' END AS outcome FROM d LEFT JOIN h ON lower(trim(x.title)) = h.k""",
    "patched_entries": f"""WITH {E}, {_I}, p AS (SELECT entry_id, updated_at, review.knowledge AS x FROM i WHERE entry_id IS NOT NULL AND review.knowledge IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY updated_at DESC, review.knowledge.title DESC, review.knowledge.kind DESC, review.knowledge.confidence DESC) = 1)
SELECT id, coalesce(p.x.title, title) AS title, coalesce(p.x.kind, kind) AS kind, coalesce(p.x.confidence, confidence) AS confidence, epoch_us(CASE WHEN p.x.confidence IS NOT NULL THEN p.updated_at ELSE last_verified END) AS last_verified FROM e LEFT JOIN p ON p.entry_id = id""",
    "entry_versions": f"""WITH {E}, n AS (SELECT DISTINCT {_TRIM.format('s')} AS old_id, id AS new_id FROM (SELECT id, unnest(supersedes) AS s FROM e) WHERE {_TRIM.format('s')} <> ''), o AS (SELECT DISTINCT id AS old_id, {_TRIM.format('superseded_by')} AS new_id FROM e WHERE {_TRIM.format('superseded_by')} <> '')
SELECT old_id, new_id, o.old_id IS NOT NULL AS said_by_old, n.old_id IS NOT NULL AS said_by_new FROM n FULL JOIN o USING (old_id, new_id)""",
    "queue_difference": f"WITH {C}, {_I}, a AS (SELECT id, NULL::VARCHAR AS entry_id FROM c), b AS (SELECT id, entry_id FROM i) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "created_entries": f"""WITH {_I}, d AS (SELECT candidate.knowledge AS x FROM i WHERE trim(coalesce(candidate.knowledge.title, '')) <> '' AND trim(coalesce(candidate.knowledge.content, '')) <> ''), h AS (SELECT x, sha256(concat_ws(chr(31), x.title, x.content, '20260101')) AS h FROM d QUALIFY row_number() OVER (PARTITION BY h ORDER BY x) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY left(h, 6) ORDER BY h) AS n FROM h), k AS (SELECT *, 'mem-20260101-' || left(h, CASE WHEN n > 1 THEN 12 ELSE 6 END) AS id FROM n)
SELECT id, x.kind AS kind, x.title AS title, coalesce(x.confidence, 0.5) AS confidence, length('# ' || x.title || chr(10) || chr(10) || x.content)::INT AS body_chars, x.kind || '/' || id || '.md' AS path FROM k""",
    "superseded_entries": f"""WITH {E}, v AS (SELECT {_TRIM.format('s')} AS o, id AS n FROM (SELECT id, unnest(supersedes) AS s FROM e) UNION SELECT id, {_TRIM.format('superseded_by')} FROM e), p AS (SELECT o, min(n) AS n FROM v WHERE o <> '' AND n <> '' AND o <> n GROUP BY o), q AS (SELECT * FROM p WHERE o IN (SELECT id FROM e) AND n IN (SELECT id FROM e)),
w AS (SELECT n, list(o) AS os FROM q GROUP BY n)
SELECT e.id, CASE WHEN q.n IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(q.n, superseded_by) AS superseded_by, CASE WHEN os IS NULL THEN len(supersedes) ELSE len(list_distinct(list_concat(coalesce(supersedes, []), os))) + coalesce(list_contains(list_transform(supersedes, lambda x: x IS NULL), true), false)::INT END::INT AS n_supersedes,
CASE WHEN os IS NULL THEN len(links) ELSE len(list_distinct(list_concat(coalesce(links, []), os))) + coalesce(list_contains(list_transform(links, lambda x: x IS NULL), true), false)::INT END::INT AS n_links, epoch_us(CASE WHEN q.n IS NOT NULL OR os IS NOT NULL THEN TIMESTAMPTZ '2026-01-01 00:00:00+00' ELSE updated END) AS updated
FROM e LEFT JOIN q ON q.o = e.id LEFT JOIN w ON w.n = e.id""",
    "vault_fingerprint": f"WITH {E} SELECT count(*) AS n, (sum(('0x' || substring(sha256(concat_ws(chr(31), id, coalesce(kind, chr(0)), coalesce(title, chr(0)), coalesce(status, chr(0)), coalesce(body, chr(0)))), 1, 15))::HUGEINT) % 1152921504606846976)::BIGINT AS mark FROM e",
    "candidate_lookup": f"WITH {E}, {_I}, l AS (SELECT id, unnest(candidate.related_entries[1:10]) AS entry_id, generate_subscripts(candidate.related_entries[1:10], 1) - 1 AS place FROM i) SELECT l.id, place::INT AS place, entry_id, left(e.title, 256) AS title, left(e.body, 2000) AS body FROM l JOIN e ON e.id = entry_id",
    "entry_review": f"WITH {E}, r AS (SELECT id, coalesce(regexp_matches(body, '{EVIDENCE}'), false) AS v, length(trim(coalesce(body, ''))) < 120 AND coalesce(len(tags), 0) = 0 AS p FROM e) SELECT id, v AS has_evidence, CASE WHEN v THEN 0.65 ELSE 0.5 END::DOUBLE AS proposed_confidence, p AS placeholder FROM r",
    "keyword_snippets": f"""WITH {E}, w AS (SELECT id, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS w FROM e), f AS (SELECT id, w, list_position(list_transform(w, lambda x: starts_with(lower(x), 'flush')), true) AS f FROM w), s AS (SELECT *, greatest(1, f - 9) AS s FROM f WHERE f > 0)
SELECT id, CASE WHEN s > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(w[s:s + 17], lambda x: CASE WHEN starts_with(lower(x), 'flush') THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN s + 18 <= len(w) THEN ' …' ELSE '' END AS snippet FROM s""",
    "prompt_context": f"WITH {_bm25_sql(TERMS, False)}, k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 8) SELECT id, left(title, 160) AS title, CASE WHEN length({_FLAT}) > 600 THEN left({_FLAT}, 600) || '…' ELSE {_FLAT} END AS excerpt FROM e JOIN k USING (id) WHERE status = 'active' ORDER BY rank LIMIT 5",
}
