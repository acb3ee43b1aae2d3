"""Graph construction and traversal against plain models on random graphs."""

import itertools
import random

import pytest

from lorespark.operators import edges as G
from lorespark.operators import traverse as T

EDGE = "from_id string, to_id string, kind string, weight double, evidence string"


def graph(spark, seed, nodes=12, n=18):
    rng = random.Random(seed)
    pairs = rng.sample(list(itertools.combinations([f"n{i:02}" for i in range(nodes)], 2)), n)
    rows = [(a, b, rng.choice(["tag", "semantic", "link"]), rng.choice([0.2, 0.4, 0.5, 0.8, 1.0]), "") for a, b in pairs]
    return rows, spark.createDataFrame(rows, EDGE)


def both(rows):
    return [(a, b, w) for x, y, _, w, _ in rows for a, b in ((x, y), (y, x))]


@pytest.mark.parametrize("seed", range(3))
def test_neighbourhood(spark, seed):
    rows, df = graph(spark, seed)
    best = {"n00": (1.0, 0)}
    front = dict(best)
    for d in (1, 2, 3):
        new = {}
        for a, b, w in both(rows):
            if a in front and b != "n00":
                s = front[a][0] * w
                if s > best.get(b, (0, 0))[0] + 1e-15 and s > new.get(b, (0, 0))[0]:
                    new[b] = (s, d)
        best |= new
        front = new
    got = {r["id"]: (round(r["score"], 9), r["depth"]) for r in T.neighbourhood(df, "n00", 3).collect()}
    assert got == {k: (round(s, 9), d) for k, (s, d) in best.items() if k != "n00"}


@pytest.mark.parametrize("seed", range(2))
def test_widest_paths(spark, seed):
    rows, df = graph(spark, seed)
    wide = {"n00": 1.0}
    for _ in range(20):
        for a, b, w in both(rows):
            if a in wide and b != "n00":
                wide[b] = max(wide.get(b, 0), min(wide[a], w))
    assert {r["id"]: r["bottleneck"] for r in T.widest_paths(df, "n00").collect()} == wide


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rows, df = graph(spark, seed, 30, 20)
    chain = [(f"c{i:02}", f"c{i + 1:02}", "link", 1.0, "") for i in range(20)]
    rows, df = rows + chain, df.unionByName(spark.createDataFrame(chain, EDGE))
    root = {x: x for r in rows for x in r[:2]} | {"alone": "alone"}
    for _ in range(40):
        for a, b, *_ in rows:
            root[a] = root[b] = min(root[a], root[b])
    ids = spark.createDataFrame([(x,) for x in root], "id string")
    assert {r["id"]: r["component"] for r in T.components(ids, df).collect()} == root
    assert T.components(ids, df.where("false")).where("id <> component").isEmpty()


def test_budget_keeps_edges_that_are_strong_at_both_ends(spark):
    rows, df = graph(spark, 5, 8, 20)
    kept = {tuple(r)[:3] for r in G.pruned(df, 2).collect()}
    rank = lambda r: (-r[3], G.KIND_ORDER.index(r[2]), r[0], r[1])
    top = {n: sorted((r for r in rows if n in r[:2] and r[2] not in G.LOAD_BEARING), key=rank)[:2] for n in {x for r in rows for x in r[:2]}}
    assert kept == {r[:3] for r in rows if r[2] in G.LOAD_BEARING or (r in top[r[0]] and r in top[r[1]])}


def test_declared_edges_drop_unknown_and_own_targets(spark):
    e = spark.createDataFrame([("a", ["b", " b ", "x", "a", None], None, "b"), ("b", None, ["a"], " ")], "id string, links array<string>, supersedes array<string>, superseded_by string")
    assert {(r["from_id"], r["to_id"], r["kind"]) for r in G.declared_edges(e).collect()} == {("a", "b", "link"), ("a", "b", "supersedes"), ("b", "a", "supersedes")}


@pytest.mark.parametrize("block", [2000, 3])
def test_tag_set_edges_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK_SETS", block)
    rng = random.Random(3)
    rows = [(f"e{i:03}", [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))] + ["scope:x"]) for i in range(60)]
    sets = G.tag_sets(spark.createDataFrame(rows, "id string, tags array<string>"))
    pairs = [(r["first_a"], r["first_b"]) for r in G.tag_set_edges(sets).collect()]
    got = set(pairs)
    assert len(got) == len(pairs)
    first = {}
    for i, t in rows:
        first.setdefault(frozenset(x for x in t if ":" not in x), i)
    first.pop(frozenset(), None)
    assert got == {(min(a, b), max(a, b)) for (s, a), (t, b) in itertools.combinations(first.items(), 2) if len(s & t) / len(s | t) >= 0.34}
