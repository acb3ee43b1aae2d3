"""Corroborating entries against all pairs."""

import itertools
import random

import pytest

from lorespark.operators import claims, edges

ENTRY = "id string, title string, body string, status string, tags array<string>"


def all_pairs(firm, vectors, least):
    """The rule, pair by pair."""
    tags = {}
    for i, tag, net in firm:
        tags.setdefault(i, set()).add((tag, net))
    for a, b in itertools.combinations(sorted(tags), 2):
        cosine = sum(w * vectors[b].get(d, 0.0) for d, w in vectors[a].items())
        if (shared := tags[a] & tags[b]) and cosine >= least:
            yield a, b, round(cosine, 9), "same claim on " + min(t for t, _ in shared)


@pytest.mark.parametrize("block", [256, 7])
def test_corroborations_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(edges, "BLOCK_CLAIMS", block)
    rng = random.Random(block)
    firm, vectors = [], {}
    for i in range(60):
        net = rng.choice([1, -1])
        firm += [(f"e{i:02}", t, net) for t in {"hot", *rng.sample(["a", "b", "scope:c"], rng.randint(0, 2))}]
        raw = {d: rng.choice([-1, 1, 2]) for d in rng.sample(range(12), 5)}
        size = sum(w * w for w in raw.values()) ** 0.5
        vectors[f"e{i:02}"] = {d: w / size for d, w in sorted(raw.items())}
    packed = spark.createDataFrame([(i, list(v), list(v.values())) for i, v in vectors.items()], "id string, dims array<int>, weights array<double>")
    got = {(r["from_id"], r["to_id"], round(r["weight"], 9), r["evidence"]) for r in edges.corroborations(spark.createDataFrame(firm, "id string, tag string, net int"), packed, 0.15, 12).collect()}
    want = set(all_pairs(firm, vectors, 0.15))
    assert got == want and max(sum(i in p[:2] for p in want) for i in vectors) > 8


def test_firm_claims_have_any_tag_and_status(spark):
    from lorespark.functions.text import POSITIVE_MARKERS

    says = " ".join(POSITIVE_MARKERS[:4])
    rows = [("a", says, "", "archived", ["t", "scope:x", "t", None]), ("b", says, None, "active", []), ("c", "plain", "", "active", ["t"]), ("d", says, "", "superseded", None)]
    assert sorted(tuple(r) for r in claims.firm(spark.createDataFrame(rows, ENTRY)).collect()) == [("a", "scope:x", 1), ("a", "t", 1)]
