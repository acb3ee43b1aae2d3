"""One object for all that can be asked of a vault: each method returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.config import GraphConfig
from lorespark.functions.scores import effective_confidence
from lorespark.functions.text import excerpt
from lorespark.operators import claims, curate, edges, index, keyword, maintain, reports, topics, traverse, vectors
from lorespark.session import cut_lineage, ensure_checkpoint_dir

#: Candidates that a search asks each layer for: four times the limit, at least 1 and at most this many.
MAX_DEPTH = 40


def full_graph(entries: DataFrame, near: DataFrame, packed: DataFrame, config: GraphConfig) -> DataFrame:
    """Edges of all six kinds within the budget, and memberships in tag sets. ``near``: nearest rows of the entries that
    look for semantic neighbours; ``packed``: the vectors of all."""
    sets = cut_lineage(edges.tag_sets(entries))
    tagged = edges.tag_set_edges(sets, config.tag_min_jaccard)
    tag = tagged.select(F.col("first_a").alias("from_id"), F.col("first_b").alias("to_id"), F.lit("tag").alias("kind"), "weight", F.concat(F.lit("shares "), "shared").alias("evidence"))
    between = edges.pruned(cut_lineage(edges.all_edges(tag)), config.max_edges_per_node).unionByName(edges.member_edges(edges.tag_members(entries, sets)))
    agreed = edges.corroborations(cut_lineage(claims.firm(entries)), packed, config.corroborate_min_similarity, config.dimensions)
    parts = [edges.declared_edges(entries), edges.semantic_edges(near), edges.claim_edges(claims.contradictions(entries)), agreed]
    return edges.pruned(cut_lineage(edges.all_edges(*parts)), config.max_edges_per_node).unionByName(between)


class Vault:
    """The entries of a vault (columns as in schema.ENTRY) as of ``now``.

    The retrieval index is opened or built on first use, in ``folder`` or in one of this vault in the shared folder.
    """

    def __init__(self, entries: DataFrame, now: Column, config: GraphConfig | None = None, folder: str | None = None):
        self.config = (config or GraphConfig()).validate()
        self.entries = entries.withColumn("effective_confidence", effective_confidence(now))
        self._now = now
        self._folder = folder or f"{ensure_checkpoint_dir(entries.sparkSession).rstrip('/')}/index-{uuid.uuid4().hex}"
        self._space: index.Index | None = None

    # reading

    def get(self, id_: str) -> DataFrame:
        """The entry of an id; an unknown one raises an error."""
        found = self.entries.where(F.col("id") == id_)
        if found.isEmpty():
            raise KeyError(id_)
        return found

    # writing: each gives the entries as they are afterwards

    def create(self, drafts: DataFrame, prefix: str = "mem") -> DataFrame:
        return self.entries.drop("effective_confidence").unionByName(maintain.created(drafts, self._now, prefix), allowMissingColumns=True)

    def supersede(self, pairs: DataFrame) -> DataFrame:
        return maintain.superseded(self.entries.drop("effective_confidence"), pairs, self._now)

    def list(self, offset: int = 0, limit: int = 50, **conditions) -> DataFrame:
        return reports.page(reports.filtered(self.entries, **conditions), offset, limit)

    def violations(self, kinds: list[str], statuses: list[str]) -> DataFrame:
        return reports.violations(self.entries, kinds, statuses)

    # retrieval

    def index(self) -> index.Index:
        """The retrieval index, opened where one fits these entries and settings, else built."""
        if self._space is None:
            self._space = index.ensured_index(self.entries, self._folder, self.config.dimensions)
        return self._space

    def keyword_search(self, query: str, limit: int = 10, every: bool = True) -> DataFrame:
        best = keyword.bm25(self.index().documents, query, every, limit)
        return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")))  # ``limit`` rows

    def semantic_search(self, query: str, limit: int = 10) -> DataFrame:
        own = self.index()
        asked = vectors.term_counts(self.entries.sparkSession.createDataFrame([("?", query)], "id string, text string"))
        return vectors.nearest(vectors.packed_vectors(asked, own.vocabulary, own.n), own.packed, limit, 0.02, self.config.dimensions)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """Hybrid search: id, title, excerpt, score and both ranks, best first."""
        depth = min(max(4 * limit, 1), MAX_DEPTH)
        fused = keyword.fuse(self.keyword_search(query, depth), self.semantic_search(query, depth), limit)
        shown = self.entries.select("id", "title", "status", "confidence", "effective_confidence", excerpt(F.col("body")).alias("excerpt"))
        return shown.join(F.broadcast(fused), "id").orderBy(F.desc("score"), "id")  # ``limit`` rows

    def similar(self, id_: str, limit: int = 10, least: float | None = None) -> DataFrame:
        packed = self.index().packed
        return vectors.nearest(packed.where(F.col("id") == id_), packed, limit, self.config.semantic_min_similarity if least is None else least, self.config.dimensions)

    # the graph

    def graph(self, queries: Column | None = None) -> DataFrame:
        """Edges of all kinds within the budget, which tag sets have apart from the entries; membership in a set (kind
        ``member``) always stays. ``queries`` says which entries look for semantic neighbours (all by default;
        each block of queries is one scan of all vectors, so on a large vault name a part)."""
        c = self.config
        packed = self.index().packed
        near = vectors.nearest(packed if queries is None else packed.join(self.entries.where(queries).select("id"), "id", "left_semi"), packed, c.semantic_top_k, c.semantic_min_similarity, c.dimensions)
        return full_graph(self.entries, near, packed, c)

    @staticmethod
    def neighbours(graph: DataFrame, id_: str, depth: int = 2, least: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
        return traverse.neighbourhood(graph, id_, min(max(depth, 1), 4), least, kinds).orderBy("depth", F.desc("score"), "id")

    @staticmethod
    def path(graph: DataFrame, a: str, b: str) -> DataFrame:
        """The widest path between two entries: place, id, bottleneck."""
        return traverse.route(cut_lineage(traverse.widest_paths(graph, a)), b).orderBy("place")

    @staticmethod
    def between(graph: DataFrame, a: str, b: str) -> DataFrame:
        return edges.between(graph, a, b)

    @staticmethod
    def strongest(graph: DataFrame, k: int = 10) -> DataFrame:
        return edges.strongest(graph, k)

    def components(self, graph: DataFrame, least: float = 0.0) -> DataFrame:
        return traverse.components(self.entries, graph, least)

    def graph_summary(self, graph: DataFrame) -> DataFrame:
        return edges.graph_summary(self.entries, graph)

    # reports

    def topics(self, top: int = 7) -> DataFrame:
        return topics.topic_sizes(topics.topic_of_entries(self.entries), self.entries, top)

    def contradictions(self) -> DataFrame:
        return claims.contradictions(self.entries)

    def patterns(self, least_members: int = 3) -> DataFrame:
        return claims.patterns(self.entries, least_members)

    def pattern_members(self, least_members: int = 3) -> DataFrame:
        return claims.pattern_members(self.entries, least_members)

    def vocabulary(self) -> DataFrame:
        return curate.tag_vocabulary(self.entries)
