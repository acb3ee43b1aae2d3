"""The graph of tag sets against the same graph with all pairs of entries."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import edges as G
from lorespark.operators import traverse as T

EDGE = "from_id string, to_id string, kind string, weight double, evidence string"
SUBJECTS = [["hot"]] * 30 + [["hot", "x"]] * 3 + [["x"]] * 2 + [["y", "z"]] * 4 + [["w", "scope:w"]] + [[]] * 2


@pytest.fixture(scope="module")
def graphs(spark):
    """Edges by sets, all pairs of entries, and the entries."""
    ids = [f"e{i:02}" for i in range(len(SUBJECTS))]
    random.Random(4).shuffle(ids)
    rows = list(zip(ids, SUBJECTS))
    entries = spark.createDataFrame(rows, "id string, tags array<string>")
    sets = G.tag_sets(entries)
    tag = G.tag_set_edges(sets).select(F.col("first_a").alias("from_id"), F.col("first_b").alias("to_id"), F.lit("tag").alias("kind"), "weight", F.lit("").alias("evidence"))
    links = [(ids[-1], ids[0], "link", 0.9, ""), (ids[36], ids[33], "semantic", 0.3, "")]
    edges = G.all_edges(tag, G.member_edges(G.tag_members(entries, sets)), spark.createDataFrame(links, EDGE)).localCheckpoint()
    pairs = list(links)
    for (a, s), (b, t) in itertools.combinations([(i, {x for x in t if ":" not in x}) for i, t in rows], 2):
        if s & t and len(s & t) / len(s | t) >= 0.34:
            pairs.append((min(a, b), max(a, b), "tag", len(s & t) / len(s | t), ""))
    return edges, pairs, ids, entries


@pytest.mark.parametrize("at", [0, 29, 31, 34, 36, -1])
@pytest.mark.parametrize("kinds", [None, ["tag"]])
def test_neighbours_of_any_member(graphs, at, kinds):
    edges, pairs, ids, _ = graphs
    best, front = {ids[at]: (1.0, 0)}, {ids[at]: 1.0}
    for d in (1, 2):
        new = {}
        for a, b, w in [(a, b, w) for x, y, k, w, _ in pairs if not kinds or k in kinds for a, b in ((x, y), (y, x))]:
            if a in front and b != ids[at] and front[a] * w > max(best.get(b, (0,))[0], new.get(b, (0,))[0]) + 1e-15:
                new[b] = (front[a] * w, d)
        best |= new
        front = {k: s for k, (s, _) in new.items()}
    got = {r["id"]: (round(r["score"], 9), r["depth"]) for r in T.neighbourhood(edges, ids[at], 2, kinds=kinds).collect()}
    assert got == {k: (round(s, 9), d) for k, (s, d) in best.items() if k != ids[at]}


def test_degrees_and_summary(graphs):
    edges, pairs, ids, entries = graphs
    ends = [(x, w) for a, b, _, w, _ in pairs for x in (a, b)]
    want = {i: (sum(x == i for x, _ in ends), round(sum(w for x, w in ends if x == i), 6)) for i in ids}
    assert {r["id"]: (r["degree"], round(r["weighted_degree"], 6)) for r in G.nodes(entries, edges).collect()} == want
    s = G.graph_summary(entries, edges).first()
    assert (s["n_edges"], s["n_isolated"]) == (len(pairs), sum(d == 0 for d, _ in want.values()))


def test_components_and_budget(graphs):
    edges, pairs, ids, entries = graphs
    root = {i: i for i in ids}
    for _ in ids:
        for a, b, *_ in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["component"] for r in T.components(entries, edges).collect()} == root
    assert G.pruned(edges, 1).where("kind = 'member'").count() == 29 + 2 + 1 + 3
