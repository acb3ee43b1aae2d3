"""Graph exports, routes, explanations and what a legible graph leaves out."""

import itertools
import json
import random

import pytest

from lorespark.operators import edges as G
from lorespark.operators import traverse as T

EDGE = "from_id string, to_id string, kind string, weight double, evidence string"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, w, "") for a, b, k, w in rows], EDGE)


def test_exports(spark):
    nodes = spark.createDataFrame([("b", 'say "x"', 1), ("a", None, 1), ("c", "back\\slash", 1)], "id string, title string, ordinal int")
    e = edges(spark, [("a", "b", "link", 1.0), ("b", "c", "tag", 0.4)])
    lines = [r["line"] for r in G.dot(nodes, e, 0.5).orderBy("part", "line").collect()]
    assert lines == ["digraph vault {", '  "a" [label=""];', '  "b" [label="say \\"x\\""];', '  "c" [label="back\\\\slash"];', '  "a" -> "b" [label="link 1.00"];', "}"]
    assert {r["line"] for r in G.mermaid(nodes, e).collect()} == {"graph LR", '  n0[""]', "  n1[\"say 'x'\"]", '  n2["back\\slash"]', "  n0 -->|link 1.00| n1", "  n1 -->|tag 0.40| n2"}
    objects = [json.loads(r["line"]) for r in G.json_lines(nodes, e).collect()]
    assert {"from": "a", "to": "b", "kind": "link", "weight": 1.0} in objects and len(objects) == 5
    assert G.dot(nodes.where("false"), e.where("false")).count() == 2 and G.mermaid(nodes.where("false"), e.where("false")).count() == 1


def test_ordinals_count_on_over_partitions(spark):
    ids = spark.createDataFrame([(f"{i:04}",) for i in random.Random(1).sample(range(5000), 700)], "id string").repartition(5)
    rows = sorted((r["id"], r["ordinal"]) for r in G.ordinals(ids).collect())
    assert [o for _, o in rows] == list(range(700))


def test_strongest_between_and_legible(spark):
    e = edges(spark, [("a", "b", "tag", 0.9), ("b", "a", "link", 0.9), ("c", "a", "link", 0.2), ("d", "e", "semantic", 0.95)])
    assert [(r["kind"], r["weight"]) for r in G.strongest(e, 3).collect()] == [("semantic", 0.95), ("link", 0.9), ("tag", 0.9)]
    assert {r["kind"] for r in G.between(e, "a", "b").collect()} == {"tag", "link"} and G.between(e, "a", "d").isEmpty()
    ids = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    plain = e.where("kind <> 'tag'")
    kept, inside = G.legible(ids, plain, 2)
    assert {r["id"] for r in kept.collect()} == {"a", "b"} and inside.count() == 1
    assert tuple(G.omitted(ids, plain, 2).first()) == (2, 1, 4, 2)
    summary = G.with_components(G.graph_summary(ids, plain), T.components(ids, plain)).first()
    assert (summary["n_components"], summary["largest"], summary["n_isolated"]) == (3, 3, 1)


def widest(rows, origin):
    best = {origin: 1.0}
    for _ in rows * 2:
        for a, b, _, w in rows:
            for x, y in ((a, b), (b, a)):
                if x in best and min(best[x], w) > best.get(y, 0) and y != origin:
                    best[y] = min(best[x], w)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_follow_the_widest_path(spark, seed):
    rng = random.Random(seed)
    rows = [(*rng.sample("abcdefghij", 2), "link", rng.choice([0.2, 0.4, 0.6, 0.8])) for _ in range(14)]
    rows += [(f"k{i}", f"k{i + 1}", "link", 0.5) for i in range(9)] + [("a", "k0", "link", 0.5)]
    paths = T.widest_paths(edges(spark, rows), "a")
    best = widest(rows, "a")
    assert {r["id"]: r["bottleneck"] for r in paths.collect()} == best
    weight = {}
    for a, b, _, w in rows:
        for pair in ((a, b), (b, a)):
            weight[pair] = max(w, weight.get(pair, 0))
    for target in ("k9", max(k for k in best if len(k) == 1)):
        way = [r["id"] for r in T.route(paths, target).orderBy("place").collect()]
        assert way[0] == "a" and way[-1] == target and len(set(way)) == len(way)
        assert min([weight[p] for p in itertools.pairwise(way)], default=1.0) == best[target]
    assert T.route(paths, "nowhere").isEmpty() and [tuple(r)[:2] for r in T.route(paths, "a").collect()] == [(0, "a")]


def test_unfinished_searches_raise(spark):
    chain = edges(spark, [(f"{i:02}", f"{i + 1:02}", "link", 1.0) for i in range(6)])
    with pytest.raises(ValueError):
        T.widest_paths(chain, "00", max_rounds=3)
