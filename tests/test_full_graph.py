"""The graph of six kinds: every kind is in it, and the analytics over it see all of them."""

import pytest
from pyspark.sql import functions as F

from lorespark.config import GraphConfig
from lorespark.functions.text import NEGATIVE_MARKERS, POSITIVE_MARKERS
from lorespark.operators import edges as G
from lorespark.operators import traverse as T
from lorespark.plans.vault import full_graph
from lorespark.queries import knowledge

PRO, CONTRA = " ".join(POSITIVE_MARKERS[:4]), " ".join(NEGATIVE_MARKERS[:4])
#: id, tags, links, supersedes, body
ROWS = [
    ("a", ["one"], ["b"], [], "x"), ("b", ["two"], [], [], "x"), ("c", ["three"], [], ["b"], "x"), ("d", ["three"], [], [], "x"), ("e", ["three", "four"], [], [], "x"),
    ("f", ["five", "s:1"], [], [], PRO), ("g", ["six", "s:1"], [], [], PRO), ("h", ["five", "seven", "eight", "nine"], [], [], CONTRA), ("i", ["ten"], [], [], "x"), ("j", [], [], [], "x"),
]
EDGES = {("a", "b", "link", 1.0), ("c", "b", "supersedes", 1.0), ("c", "d", "tag", 1.0), ("c", "e", "tag", 0.5), ("d", "e", "tag", 0.5), ("f", "g", "corroborates", 0.8), ("f", "h", "contradicts", 0.8), ("h", "i", "semantic", 0.4)}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(i, "", "active", t, x, s, None, b) for i, t, x, s, b in ROWS]
    entries = spark.createDataFrame(rows, "id string, title string, status string, tags array<string>, links array<string>, supersedes array<string>, superseded_by string, body string")
    near = spark.createDataFrame([("i", "h", 0.4)], "query_id string, id string, similarity double")
    packed = spark.createDataFrame([("f", [0], [1.0]), ("g", [0, 1], [0.8, 0.6]), ("h", [2], [1.0])], "id string, dims array<int>, weights array<double>")
    return entries, full_graph(entries, near, packed, GraphConfig()).localCheckpoint()


def test_every_kind_counts(graph):
    want = {k: sum(e[2] == k for e in EDGES) for k in G.KIND_ORDER[:6]}
    assert {r["kind"]: r["n"] for r in G.kind_counts(graph[1]).collect()} == want


def test_analytics_see_all_kinds(graph):
    entries, edges = graph
    want = {i: (sum(i in e[:2] for e in EDGES), round(sum(e[3] for e in EDGES if i in e[:2]), 6)) for i, *_ in ROWS}
    assert {r["id"]: (r["degree"], round(r["weighted_degree"], 6)) for r in G.nodes(entries.select("id"), edges).collect()} == want
    assert {r["id"]: r["component"] for r in T.components(entries, edges).collect()} == dict.fromkeys("abcde", "a") | dict.fromkeys("fghi", "f") | {"j": "j"}
    assert {r["id"]: round(r["score"], 6) for r in T.neighbourhood(edges, "g", 3).collect()} == {"f": 0.8, "h": 0.64, "i": 0.256}
    assert {r["id"]: r["bottleneck"] for r in T.widest_paths(edges, "a").collect()} == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 0.5}


def test_the_registered_graph_has_tag_edges(spark):
    graph = knowledge.graph_edges(spark, "/root/testdata/sf0.001")
    assert {"link", "tag", "semantic"} <= {r["kind"] for r in graph.select("kind").distinct().collect()}
    assert graph.where(F.col("kind") == "member").count() > 0
