"""Queries of claims, the graph, topics and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.config import GraphConfig
from lorespark.functions.text import INFLECTIONS, NEGATIVE_MARKERS, POSITIVE_MARKERS, TITLE_STOP_WORDS
from lorespark.operators import claims as C
from lorespark.operators import curate as U
from lorespark.operators import edges as G
from lorespark.operators import topics as P
from lorespark.operators import traverse as T
from lorespark.operators import vectors as V
from lorespark.operators.copies import earliest_copy
from lorespark.plans.vault import full_graph
from lorespark.queries.base import E, captures, entries
from lorespark.queries.base import C as CAPTURES
from lorespark.queries.retrieval import _NEAR, _VECTORS, DIMENSIONS, _space, asked, neighbours
from lorespark.session import cut_lineage, table


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir, "kind", "title", "status", "confidence", "tags", "updated", "body", "links", "supersedes", "superseded_by")


# claims


def entry_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claims(_e(spark, sf_dir).select("id", F.concat_ws(" ", "title", "body").alias("text")))


def capture_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claims(captures(spark, sf_dir).select("id", F.coalesce("input.outcome", F.lit("")).alias("text"))).groupBy("net", "strength").agg(F.count("*").alias("n"))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contradictions(_e(spark, sf_dir))


def disputed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.disputed_subjects(_e(spark, sf_dir))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.patterns(_e(spark, sf_dir)).select("subject", "n_members", F.array_join("first_titles", " | ").alias("first_titles"))


def pattern_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of each pattern, of which patterns shows the first titles."""
    return C.pattern_members(_e(spark, sf_dir))


def monthly_reflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reflection(_e(spark, sf_dir), F.date_format("updated", "yyyy-MM"))


# graph


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(G.declared_edges(_e(spark, sf_dir)))


def edges_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.declared_edges(_e(spark, sf_dir)).select("from_id", "to_id", "kind")


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tag_sets(_e(spark, sf_dir)).select("first_id", "n_entries", F.array_join("subjects", ", ").alias("subjects"))


def tag_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry with subject tags and the first entry of its set: with edges_tag, all its tag edges."""
    e = _e(spark, sf_dir)
    return G.tag_members(e, G.tag_sets(e)).select("id", "first_id", F.array_join("subjects", ", ").alias("subjects"))


def edges_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tag_set_edges(cut_lineage(G.tag_sets(_e(spark, sf_dir)))).select("first_a", "first_b", F.round("weight", 6).alias("weight"), "shared")


def edges_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.semantic_edges(neighbours(spark, sf_dir)).select("from_id", "to_id", F.round("weight", 6).alias("weight"))


def edges_corroborating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that share a tag and lean the same way (a margin of one marker) with a cosine of 0.15."""
    firm = cut_lineage(C.firm(_e(spark, sf_dir), 1))
    return G.corroborations(firm, cut_lineage(_space(spark, sf_dir)[2]), 0.15, DIMENSIONS).select("from_id", "to_id", F.round("weight", 6).alias("weight"), "evidence")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all six kinds in one graph, within the budget of inferred edges; semantic ones from the query set."""
    packed = cut_lineage(_space(spark, sf_dir)[2])
    config = GraphConfig(dimensions=DIMENSIONS)
    near = V.nearest(asked(packed), packed, config.semantic_top_k, config.semantic_min_similarity, DIMENSIONS)
    return cut_lineage(full_graph(_e(spark, sf_dir), near, packed, config))


def edges_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pruned(G.all_edges(G.semantic_edges(neighbours(spark, sf_dir))), 4).select("from_id", "to_id")


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.kind_counts(graph_edges(spark, sf_dir))


def full_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nodes(_e(spark, sf_dir).select("id"), graph_edges(spark, sf_dir)).select("id", "degree", F.round("weighted_degree", 6).alias("weighted_degree"))


def full_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.degrees(graph_edges(spark, sf_dir)).withColumn("weighted_degree", F.round("weighted_degree", 6))
    return d.orderBy(F.desc("degree"), F.desc("weighted_degree"), "id").limit(10)


def full_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_summary(_e(spark, sf_dir).select("id"), graph_edges(spark, sf_dir))


def full_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dot(_e(spark, sf_dir), graph_edges(spark, sf_dir))


def full_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops in the graph of six kinds around the entry with most declared edges."""
    return T.neighbourhood(graph_edges(spark, sf_dir), _origin(declared(spark, sf_dir)), 2).select("id", F.round("score", 6).alias("score"), "depth")


def full_widest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.widest_paths(graph_edges(spark, sf_dir), _origin(declared(spark, sf_dir))).select("id", "bottleneck")


def full_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.components(_e(spark, sf_dir), graph_edges(spark, sf_dir))


def full_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nodes(_e(spark, sf_dir).select("id"), declared(spark, sf_dir)).select("id", "degree", "weighted_degree")


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(declared(spark, sf_dir)).orderBy(F.desc("degree"), F.desc("weighted_degree"), "id").limit(10).select("id", "degree")


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, ids = declared(spark, sf_dir), _e(spark, sf_dir).select("id")
    s = G.with_components(G.graph_summary(ids, edges), T.components(ids, edges))
    return s.select("n_nodes", "n_edges", F.round("density", 9).alias("density"), F.round("mean_degree", 6).alias("mean_degree"), "n_isolated", "n_components", "largest")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared edges, links at half the weight of versions."""
    return declared(spark, sf_dir).withColumn("weight", F.when(F.col("kind") == "link", 0.5).otherwise(0.8))


def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dot(_e(spark, sf_dir), _weighted(spark, sf_dir), 0.6)


def graph_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mermaid(_e(spark, sf_dir), _weighted(spark, sf_dir))


def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.json_lines(_e(spark, sf_dir), _weighted(spark, sf_dir))


def strongest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = G.tag_set_edges(cut_lineage(G.tag_sets(_e(spark, sf_dir)))).select(F.col("first_a").alias("from_id"), F.col("first_b").alias("to_id"), F.lit("tag").alias("kind"), "weight")
    return G.strongest(tag.unionByName(_weighted(spark, sf_dir).drop("evidence")), 40).select("from_id", "to_id", "kind", F.round("weight", 6).alias("weight"))


def legible_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.omitted(_e(spark, sf_dir).select("id"), declared(spark, sf_dir), 100)


def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that joins the entry with most declared edges and the first of its neighbours."""
    edges = _weighted(spark, sf_dir)
    origin = _origin(edges)
    other = T.both_ways(edges).where(F.col("a") == origin).agg(F.min("b")).first()[0] or ""
    return G.between(edges, origin, other).select("from_id", "to_id", "kind", "weight")


def widest_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest path from the entry with most declared edges to the greatest id that it reaches."""
    edges = _weighted(spark, sf_dir)
    paths = cut_lineage(T.widest_paths(edges, _origin(edges)))
    return T.route(paths, paths.agg(F.max("id")).first()[0])


def _origin(edges: DataFrame) -> str:
    row = G.degrees(edges).orderBy(F.desc("degree"), "id").first()
    return row["id"] if row else ""


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops over declared edges, links of weight 0.5 and versions of 0.8, around the entry that has most of them."""
    edges = _weighted(spark, sf_dir)
    return T.neighbourhood(edges, _origin(edges), 2).select("id", F.round("score", 6).alias("score"), "depth")


def widest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = declared(spark, sf_dir)
    weighted = edges.withColumn("weight", F.when(F.col("kind") == "link", 0.5).otherwise(1.0))
    return T.widest_paths(weighted, _origin(edges)).select("id", "bottleneck")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.components(_e(spark, sf_dir), declared(spark, sf_dir))


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


# topics


def entry_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.topic_of_entries(_e(spark, sf_dir))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _e(spark, sf_dir)
    t = P.topic_sizes(P.topic_of_entries(e), e)
    return t.select("topic", "basis", "n_entries", F.round("share", 6).alias("share"), F.round("mean_confidence", 6).alias("mean_confidence"))


def title_token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.title_token_df(_e(spark, sf_dir))


def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _e(spark, sf_dir)
    return P.topic_keywords(P.topic_of_entries(e), e).select("topic", "token", "n", F.round("score", 6).alias("score"), "rank")


def topic_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _e(spark, sf_dir)
    return P.satellites(P.topic_of_entries(e), e)


# curation and the queue


def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.tag_vocabulary(_e(spark, sf_dir))


def canonical_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.canonical_tags(_e(spark, sf_dir)).select("id", F.array_join("subjects", "|").alias("subjects"))


def extracted_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = captures(spark, sf_dir).select("id", F.concat_ws("\n", "input.context", "input.action", "input.outcome").alias("text"))
    return U.extracted(text).select("id", "n_sentences", F.array_join("kept", " ").alias("kept"), "n_evidence", "confidence")


def capture_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.capture_keys(captures(spark, sf_dir)).where("n_ids > 1")


def queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.latest_states(table(spark, sf_dir, "queue_items")).groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


def related_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.related_entries(captures(spark, sf_dir), _e(spark, sf_dir))


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = earliest_copy(table(spark, sf_dir, "sessions"), "session_id", {"turns": F.col("turns"), "forked": F.col("forked"), "incomplete": F.col("incomplete")})
    return U.session_states(s, captures(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = earliest_copy(table(spark, sf_dir, "sessions"), "session_id", {"turns": F.col("turns"), "source_agent": F.col("source_agent")})
    t = s.select("session_id", "source_agent", F.posexplode("turns").alias("place", "t"))
    return t.select("session_id", "source_agent", "place", F.col("t.id").alias("turn_id"), F.length("t.prompt").alias("prompt_chars"), F.length("t.response").alias("response_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        entry_claims, capture_claims, contradictions, disputed_subjects, patterns, pattern_members, monthly_reflection, edges_declared, tag_sets, tag_members, edges_tag, edges_semantic, edges_corroborating, edges_pruned, edge_counts, node_degrees, hubs,
        graph_mermaid, graph_json, strongest_edges, legible_graph, edges_between, widest_route, full_degrees, full_hubs, full_summary, full_dot, full_neighbourhood, full_widest_paths, full_components, full_component_sizes, graph_summary, graph_dot, neighbourhood, widest_paths, components, component_sizes, entry_topics, topics, title_token_df, topic_keywords, topic_satellites, tag_vocabulary, canonical_tags, extracted_captures,
        capture_deliveries, queue_states, related_entries, session_states, session_turns,
    )
}

_q = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _markers(markers: list[str]) -> str:
    words = _q(m for m in markers if m.isalnum())
    phrases = [m.replace("'", "''") for m in markers if not m.isalnum()]
    ends = _q(INFLECTIONS)
    count = f"len(list_filter([{words}], lambda m: list_has_any(ws, list_transform([{ends}], lambda s: m || s))))"
    return " + ".join([count, *(f"contains(tx, '{p}')::INT" for p in phrases)])


def _claims(source: str) -> str:
    return f"""cw AS (SELECT *, regexp_extract_all(tx, '[\\p{{L}}\\p{{N}}]+') AS ws FROM ({source})),
cc AS (SELECT * EXCLUDE (ws, tx), {_markers(POSITIVE_MARKERS)} AS positive, {_markers(NEGATIVE_MARKERS)} AS negative FROM cw),
cl AS (SELECT *, sign(positive - negative)::INT AS net, abs(positive - negative) AS strength, abs(positive - negative) >= 2 AS decisive FROM cc)"""


_SUBJ = "list_sort(list_distinct(list_filter(tags, lambda t: t IS NOT NULL AND NOT contains(t, ':'))))"
_STATED = f"""{E}, {_claims(f"SELECT id, {_SUBJ} AS subjects, lower(concat_ws(' ', title, body)) AS tx FROM e WHERE status NOT IN ('superseded', 'archived')")},
st AS (SELECT id, unnest(subjects) AS subject, net FROM cl WHERE decisive)"""
_DECL = f"""{E}, dr AS (SELECT id AS from_id, 'link' AS kind, unnest(links) AS t FROM e UNION ALL SELECT id, 'supersedes', unnest(supersedes) FROM e UNION ALL SELECT id, 'supersedes', superseded_by FROM e),
d AS (SELECT DISTINCT from_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS to_id, kind FROM dr WHERE t IS NOT NULL), decl AS (SELECT from_id, to_id, kind FROM d WHERE to_id <> from_id AND to_id IN (SELECT id FROM e)),
ends AS (SELECT from_id AS id FROM decl UNION ALL SELECT to_id FROM decl), deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"""
_SETS = f"{E}, ts AS (SELECT {_SUBJ} AS subjects, count(*) AS n_entries, min(id) AS first_id FROM e GROUP BY 1 HAVING len(subjects) > 0)"
_TITLE = f"""tr AS (SELECT id, unnest(regexp_extract_all(title, '[A-Za-z0-9_+#-]+|[\\x{{4e00}}-\\x{{9fff}}\\x{{00aa}}-\\x{{024f}}\\x{{0370}}-\\x{{1fff}}\\x{{3040}}-\\x{{30ff}}]+')) AS r FROM e),
tw AS (SELECT id, lower(r) AS w, r FROM tr), tp AS (SELECT id, w AS token FROM tw WHERE regexp_matches(r, '^[A-Za-z0-9_+#-]')
UNION SELECT id, unnest(regexp_split_to_array(w, '[-_]')) FROM tw WHERE regexp_matches(r, '^[A-Za-z0-9_+#-]') AND regexp_matches(w, '[-_]') AND length(w) >= 5),
tt AS (SELECT DISTINCT id, token FROM tp WHERE length(token) >= 3 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({_q(TITLE_STOP_WORDS)})
UNION SELECT id, unnest(list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) FROM tw WHERE NOT regexp_matches(r, '^[A-Za-z0-9_+#-]')), tdf AS (SELECT token, count(*) AS df FROM tt GROUP BY token)"""
_TOPIC = f"""{E}, hd AS (SELECT id, kind, title, tags, trim(regexp_extract(title, '^([^—·|]*)', 1)) AS h FROM e),
hs AS (SELECT *, trim(regexp_replace(h, '[,.:;\\-，。：]+$', '')) AS c, len(list_filter(regexp_split_to_array(h, '\\s+'), lambda w: w <> '')) AS nw FROM hd),
sj AS (SELECT *, CASE WHEN h <> '' AND length(h) <= 60 AND (nw <= 6 OR contains(h, ':')) AND lower(h) NOT IN ({_q(TITLE_STOP_WORDS)}) AND length(c) >= 3 THEN c END AS subject FROM hs),
sn AS (SELECT *, count(*) OVER (PARTITION BY subject) AS sc FROM sj), nm AS (SELECT id, subject AS topic, 'subject' AS basis FROM sn WHERE subject IS NOT NULL AND sc >= 2), rs AS (SELECT id, kind, tags FROM sn WHERE subject IS NULL OR sc < 2),
gd AS (SELECT tag, count(*) AS df FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM e) GROUP BY tag), gr AS (SELECT tag, df FROM gd WHERE df < greatest(floor((SELECT count(*) FROM e) * 0.5), 2)),
lt AS (SELECT id, tag FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM rs) JOIN gr USING (tag) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df DESC, tag) = 1), lg AS (SELECT *, count(*) OVER (PARTITION BY tag) AS c FROM lt),
topic AS (SELECT * FROM nm UNION ALL SELECT rs.id, coalesce(tag, kind), CASE WHEN tag IS NULL THEN 'kind' ELSE 'tag' END FROM rs LEFT JOIN (SELECT id, tag FROM lg WHERE c >= 2) g ON g.id = rs.id)"""
_VOCAB = f"{E}, us AS (SELECT DISTINCT id, trim(t) AS tag FROM (SELECT id, unnest(tags) AS t FROM e) WHERE t IS NOT NULL AND trim(t) <> ''), sp AS (SELECT lower(tag) AS folded, tag, count(*) AS n FROM us GROUP BY ALL), vo AS (SELECT folded, sum(n)::BIGINT AS n, arg_min(tag, (-n, tag)) AS canonical, count(*) AS n_spellings FROM sp GROUP BY folded)"
_EDGES = f"{_NEAR}, se AS (SELECT least(query_id, id) AS from_id, greatest(query_id, id) AS to_id, max(similarity) AS weight FROM near GROUP BY ALL)"

_QUOTE = """replace(replace(coalesce(title, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"')"""
SQL = {
    "entry_claims": f"WITH {E}, {_claims('SELECT id, lower(concat_ws(chr(32), title, body)) AS tx FROM e')} SELECT id, positive, negative, net, strength, decisive FROM cl",
    "capture_claims": f"WITH {CAPTURES}, {_claims('SELECT id, lower(coalesce(input.outcome, chr(32))) AS tx FROM c')} SELECT net, strength, count(*) AS n FROM cl GROUP BY ALL",
    "contradictions": f"WITH {_STATED} SELECT p.subject, least(p.id, n.id) AS id_a, greatest(p.id, n.id) AS id_b, CASE WHEN p.id < n.id THEN 1 ELSE -1 END AS net_a, CASE WHEN p.id < n.id THEN -1 ELSE 1 END AS net_b FROM st p JOIN st n ON p.subject = n.subject AND p.net > 0 AND n.net < 0",
    "disputed_subjects": f"WITH {_STATED} SELECT subject, count(*) FILTER (net > 0) AS n_positive, count(*) FILTER (net < 0) AS n_negative, min(id) FILTER (net > 0) AS positive_id, min(id) FILTER (net < 0) AS negative_id FROM st GROUP BY subject HAVING n_positive > 0 AND n_negative > 0",
    "patterns": f"WITH {E}, u AS (SELECT id, title, unnest({_SUBJ}) AS subject FROM e WHERE status NOT IN ('superseded', 'archived')), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY title, id) AS r, count(*) OVER (PARTITION BY subject) AS n_members FROM u) SELECT subject, any_value(n_members) AS n_members, string_agg(title, ' | ' ORDER BY r) FILTER (r <= 5) AS first_titles FROM r WHERE n_members >= 3 GROUP BY subject",
    "pattern_members": f"WITH {E}, u AS (SELECT id, title, unnest({_SUBJ}) AS subject FROM e WHERE status NOT IN ('superseded', 'archived')) SELECT subject, id, title, row_number() OVER (PARTITION BY subject ORDER BY title, id) AS rank FROM u QUALIFY count(*) OVER (PARTITION BY subject) >= 3",
    "edges_declared": f"WITH {_DECL} SELECT from_id, to_id, kind FROM decl",
    "tag_sets": f"WITH {_SETS} SELECT first_id, n_entries, array_to_string(subjects, ', ') AS subjects FROM ts",
    "tag_members": f"WITH {_SETS} SELECT m.id, first_id, array_to_string(subjects, ', ') AS subjects FROM (SELECT id, {_SUBJ} AS subjects FROM e) m JOIN ts USING (subjects)",
    "edges_tag": f"WITH {_SETS} SELECT a.first_id AS first_a, b.first_id AS first_b, round(len(list_intersect(a.subjects, b.subjects)) / len(list_distinct(list_concat(a.subjects, b.subjects))), 6) AS weight, array_to_string(list_sort(list_intersect(a.subjects, b.subjects)), ', ') AS shared FROM ts a JOIN ts b ON a.first_id < b.first_id AND list_has_any(a.subjects, b.subjects) WHERE len(list_intersect(a.subjects, b.subjects)) / len(list_distinct(list_concat(a.subjects, b.subjects))) >= 0.34 - 1e-9",
    "edges_semantic": f"WITH {_EDGES} SELECT from_id, to_id, round(weight, 6) AS weight FROM se",
    "edges_pruned": f"WITH {_EDGES}, en AS (SELECT from_id AS x, * FROM se UNION ALL SELECT to_id, * FROM se), rk AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY weight DESC, from_id, to_id) AS r FROM en) SELECT from_id, to_id FROM rk WHERE r <= 4 GROUP BY ALL HAVING count(*) = 2",
    "node_degrees": f"WITH {_DECL} SELECT e.id, coalesce(degree, 0) AS degree, coalesce(degree, 0)::DOUBLE AS weighted_degree FROM e LEFT JOIN deg ON deg.id = e.id",
    "hubs": f"WITH {_DECL} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 10",
    "graph_summary": f"WITH RECURSIVE {_DECL}, a AS (SELECT from_id AS a, to_id AS b FROM decl UNION SELECT to_id, from_id FROM decl), r(id, root) AS (SELECT id, id FROM e UNION SELECT a.b, r.root FROM r JOIN a ON a.a = r.id), cs AS (SELECT c, count(*) AS size FROM (SELECT id, min(root) AS c FROM r GROUP BY id) GROUP BY c), k AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM decl) AS m, (SELECT count(*) FROM deg) AS u) SELECT n AS n_nodes, m AS n_edges, round(m / (n * (n - 1) / 2), 9) AS density, round(2 * m / n, 6) AS mean_degree, n - u AS n_isolated, (SELECT count(*) FROM cs) AS n_components, (SELECT max(size) FROM cs) AS largest FROM k",
    "graph_dot": f"""WITH {_DECL} SELECT 0 AS part, 'digraph vault {{' AS line UNION ALL SELECT 1, '  "' || id || '" [label="' || {_QUOTE} || '"];' FROM e UNION ALL SELECT 2, '  "' || from_id || '" -> "' || to_id || '" [label="' || kind || ' 0.80"];' FROM decl WHERE kind = 'supersedes' UNION ALL SELECT 3, '}}'""",
    "graph_mermaid": f"""WITH {_DECL}, o AS (SELECT id, title, row_number() OVER (ORDER BY id) - 1 AS k FROM e) SELECT 0 AS part, 'graph LR' AS line UNION ALL SELECT 1, '  n' || k || '["' || replace(coalesce(title, ''), '"', chr(39)) || '"]' FROM o UNION ALL SELECT 2, '  n' || a.k || ' -->|' || kind || CASE WHEN kind = 'link' THEN ' 0.50' ELSE ' 0.80' END || '| n' || b.k FROM decl JOIN o a ON a.id = from_id JOIN o b ON b.id = to_id""",
    "graph_json": f"""WITH {_DECL} SELECT 1 AS part, json_object('id', id, 'title', title)::VARCHAR AS line FROM e UNION ALL SELECT 2, json_object('from', from_id, 'to', to_id, 'kind', kind, 'weight', CASE WHEN kind = 'link' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END)::VARCHAR FROM decl""",
    "strongest_edges": f"WITH {_DECL}, {_SETS.removeprefix(E + ', ')}, g AS (SELECT a.first_id AS from_id, b.first_id AS to_id, 'tag' AS kind, len(list_intersect(a.subjects, b.subjects)) / len(list_distinct(list_concat(a.subjects, b.subjects))) AS weight FROM ts a JOIN ts b ON a.first_id < b.first_id AND list_has_any(a.subjects, b.subjects) UNION ALL SELECT from_id, to_id, kind, CASE WHEN kind = 'link' THEN 0.5 ELSE 0.8 END FROM decl) SELECT from_id, to_id, kind, round(weight, 6) AS weight FROM g WHERE weight >= 0.34 - 1e-9 ORDER BY g.weight DESC, list_position(['link', 'supersedes', 'tag'], kind), from_id, to_id LIMIT 40",
    "legible_graph": f"WITH {_DECL}, k AS (SELECT e.id FROM e LEFT JOIN deg ON deg.id = e.id ORDER BY coalesce(degree, 0) DESC, e.id LIMIT 100), i AS (SELECT count(*) AS n FROM decl WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k)) SELECT (SELECT count(*) FROM k) AS kept_nodes, n AS kept_edges, (SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS omitted_nodes, (SELECT count(*) FROM decl) - n AS omitted_edges FROM i",
    "edges_between": f"WITH {_DECL}, o AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1), n AS (SELECT min(CASE WHEN from_id = o.id THEN to_id ELSE from_id END) AS n FROM decl, o WHERE from_id = o.id OR to_id = o.id) SELECT from_id, to_id, kind, CASE WHEN kind = 'link' THEN 0.5 ELSE 0.8 END::DOUBLE AS weight FROM decl, o, n WHERE (from_id = o.id AND to_id = n.n) OR (to_id = o.id AND from_id = n.n)",
    "edges_corroborating": f"WITH {_VECTORS}, {_claims('SELECT id, tags, lower(concat_ws(chr(32), title, body)) AS tx FROM e')}, fm AS (SELECT DISTINCT id, net, unnest(tags) AS tag FROM cl WHERE net <> 0), pr AS (SELECT a.id AS from_id, b.id AS to_id, min(a.tag) AS tag FROM fm a JOIN fm b ON a.tag = b.tag AND a.net = b.net AND a.id < b.id GROUP BY ALL), cs AS (SELECT from_id, to_id, tag, sum(a.w * b.w) AS weight FROM pr JOIN vec a ON a.id = from_id JOIN vec b ON b.id = to_id AND b.dim = a.dim GROUP BY ALL HAVING sum(a.w * b.w) >= 0.15) SELECT from_id, to_id, round(weight, 6) AS weight, 'same claim on ' || tag AS evidence FROM cs",
    "neighbourhood": f"WITH {_DECL}, o AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1), a AS (SELECT a, b, max(w) AS w FROM (SELECT from_id AS a, to_id AS b, CASE WHEN kind = 'link' THEN 0.5 ELSE 0.8 END::DOUBLE AS w FROM decl UNION ALL SELECT to_id, from_id, CASE WHEN kind = 'link' THEN 0.5 ELSE 0.8 END::DOUBLE FROM decl) GROUP BY a, b), h1 AS (SELECT b AS id, w FROM a WHERE a = (SELECT id FROM o)), h2 AS (SELECT b AS id, h1.w * a.w AS w FROM a JOIN h1 ON a.a = h1.id), u AS (SELECT id, w, 1 AS depth FROM h1 UNION ALL SELECT id, w, 2 FROM h2) SELECT id, round(w, 6) AS score, depth::INT AS depth FROM u WHERE id <> (SELECT id FROM o) QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, depth) = 1",
    "components": f"WITH RECURSIVE {_DECL}, a AS (SELECT from_id AS a, to_id AS b FROM decl UNION SELECT to_id, from_id FROM decl), r(id, root) AS (SELECT id, id FROM e UNION SELECT a.b, r.root FROM r JOIN a ON a.a = r.id) SELECT id, min(root) AS component FROM r GROUP BY id",
    "widest_paths": f"WITH RECURSIVE {_DECL}, o AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1), a AS (SELECT from_id AS a, to_id AS b, kind FROM decl UNION SELECT to_id, from_id, kind FROM decl), r1(id) AS (SELECT id FROM o UNION SELECT b FROM r1 JOIN a ON a = id AND kind = 'supersedes'), r2(id) AS (SELECT id FROM o UNION SELECT b FROM r2 JOIN a ON a = id) SELECT id, CASE WHEN id IN (SELECT id FROM r1) THEN 1.0 ELSE 0.5 END::DOUBLE AS bottleneck FROM r2",
    "component_sizes": f"WITH RECURSIVE {_DECL}, a AS (SELECT from_id AS a, to_id AS b FROM decl UNION SELECT to_id, from_id FROM decl), r(id, root) AS (SELECT id, id FROM e UNION SELECT a.b, r.root FROM r JOIN a ON a.a = r.id), c AS (SELECT id, min(root) AS component FROM r GROUP BY id), k AS (SELECT component, count(*) AS size FROM c GROUP BY component) SELECT size, count(*) AS n_components FROM k GROUP BY size",
    "monthly_reflection": f"""WITH {_STATED}, ds AS (SELECT subject FROM st GROUP BY subject HAVING count(*) FILTER (net > 0) > 0 AND count(*) FILTER (net < 0) > 0),
t AS (SELECT strftime(updated AT TIME ZONE 'UTC', '%Y-%m') AS period, unnest({_SUBJ}) AS subject FROM e WHERE status NOT IN ('superseded', 'archived')), g AS (SELECT period, subject, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT period, count(*) FILTER (subject IN (SELECT subject FROM ds)) AS n_disputed, count(*) FILTER (n >= 2) AS n_patterns FROM g GROUP BY period), m AS (SELECT strftime(updated AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n_entries FROM e GROUP BY 1)
SELECT period, n_entries, coalesce(n_disputed, 0) AS n_disputed, coalesce(n_patterns, 0) AS n_patterns FROM m LEFT JOIN p USING (period)""",
    "entry_topics": f"WITH {_TOPIC} SELECT id, topic, basis FROM topic",
    "topics": f"WITH {_TOPIC} SELECT topic, basis, count(*) AS n_entries, round(count(*) / (SELECT count(*) FROM e), 6) AS share, round(avg(confidence), 6) AS mean_confidence FROM topic JOIN e USING (id) GROUP BY topic, basis ORDER BY n_entries DESC, topic, basis LIMIT 7",
    "title_token_df": f"WITH {E}, {_TITLE} SELECT token, df FROM tdf",
    "topic_keywords": f"WITH {_TOPIC}, {_TITLE}, lc AS (SELECT topic, token, count(*) AS n FROM topic JOIN tt USING (id) WHERE length(token) >= 3 GROUP BY ALL HAVING count(*) >= 2), sc AS (SELECT topic, token, n, n / df * sqrt(n) AS score FROM lc JOIN tdf USING (token) WHERE df * 3 <= (SELECT count(*) FROM e) * 2) SELECT topic, token, n, round(score, 6) AS score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, n DESC, token) AS rank FROM sc QUALIFY rank <= 6",
    "topic_satellites": f"WITH {_TOPIC}, g AS (SELECT topic, label, count(*) AS n FROM topic JOIN (SELECT DISTINCT id, unnest(tags) AS label FROM e) USING (id) WHERE label IS NOT NULL GROUP BY ALL) SELECT topic, label, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, label) AS rank FROM g QUALIFY rank <= 6",
    "tag_vocabulary": f"WITH {_VOCAB} SELECT folded, n, canonical, n_spellings FROM vo",
    "canonical_tags": f"WITH {_VOCAB}, uf AS (SELECT DISTINCT id, lower(trim(t)) AS folded FROM (SELECT id, unnest(tags) AS t FROM e)), j AS (SELECT id, canonical, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, canonical) AS r FROM uf JOIN vo USING (folded) WHERE n >= 2 AND NOT contains(folded, ':')) SELECT id, string_agg(canonical, '|' ORDER BY r) AS subjects FROM j WHERE r <= 6 GROUP BY id",
    "capture_deliveries": f"WITH {CAPTURES} SELECT lower(trim(input.source_agent)) AS source_agent, input.project AS project, input.session_id AS session_id, input.event_id AS event_id, count(DISTINCT id) AS n_ids, count(DISTINCT (input.title, input.context, input.action, input.outcome)) AS n_contents FROM c GROUP BY 1, 2, 3, 4 HAVING n_ids > 1",
    "queue_states": "WITH l AS (SELECT id, status, attempts FROM queue_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, status DESC, attempts DESC) = 1) SELECT status, count(*) AS n, sum(attempts)::BIGINT AS attempts FROM l GROUP BY status",
    "related_entries": f"WITH {E}, {CAPTURES}, a AS (SELECT id AS entry_id, lower(title) AS t, tags, updated FROM e WHERE status = 'active'), p AS (SELECT c.id AS capture_id, entry_id, updated FROM c JOIN a ON lower(c.input.title) = a.t UNION SELECT x.id, y.entry_id, y.updated FROM (SELECT id, unnest(input.tags) AS k FROM c) x JOIN (SELECT entry_id, updated, unnest(tags) AS k FROM a) y USING (k)) SELECT capture_id, entry_id, row_number() OVER (PARTITION BY capture_id ORDER BY updated DESC, entry_id) AS rank FROM p QUALIFY rank <= 20",
    "session_states": f"WITH {CAPTURES}, s AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY loaded_at) = 1) SELECT CASE WHEN session_id IN (SELECT input.session_id FROM c WHERE input.session_id IS NOT NULL) THEN 'captured' WHEN forked THEN 'forked' WHEN coalesce(len(turns), 0) = 0 THEN 'empty' WHEN incomplete THEN 'incomplete' ELSE 'available' END AS state, count(*) AS n FROM s GROUP BY 1",
    "session_turns": "WITH s AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY loaded_at) = 1), t AS (SELECT session_id, source_agent, unnest(turns) AS t, generate_subscripts(turns, 1) AS k FROM s) SELECT session_id, source_agent, (k - 1)::INT AS place, t.id AS turn_id, length(t.prompt)::INT AS prompt_chars, length(t.response)::INT AS response_chars FROM t",
}
