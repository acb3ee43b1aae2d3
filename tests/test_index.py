"""The retrieval index: kept, found again, and built anew where it no longer fits."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorespark.operators import index as I
from lorespark.operators import keyword as K
from lorespark.operators import vectors as V

ENTRY = "id string, title string, tags array<string>, body string, tokens string, length string"


def entries(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ENTRY)


ROWS = [("a", "Café index", ["retrieval"], "Résumé of the naïve index"), ("b", "Stale lock", None, None), ("c", None, ["x", None], "An index of cafes"), ("d", None, None, None)]


def test_an_index_is_found_again_until_something_changes(spark, tmp_path):
    folder, e = str(tmp_path / "index"), entries(spark, ROWS)
    assert I.open_index(spark, folder, I.mark(e)) is None
    built = I.ensured_index(e, folder)
    again = I.open_index(spark, folder, I.mark(e))
    assert again is not None and again.n == built.n == 4
    assert sorted(map(tuple, again.documents.select("id", "length").collect())) == sorted(map(tuple, built.documents.select("id", "length").collect()))
    assert I.open_index(spark, folder, I.mark(e), 1024) is None
    changed = entries(spark, ROWS[:3])
    assert I.mark(changed) != I.mark(e) and I.open_index(spark, folder, I.mark(changed)) is None
    assert I.ensured_index(changed, folder).n == 3


def test_an_empty_vault_has_an_index(spark, tmp_path):
    own = I.build_index(entries(spark, []), str(tmp_path / "index"))
    assert own.n == 0 and own.packed.isEmpty() and K.bm25(own.documents, "index").isEmpty()


def test_diacritics_are_folded_on_both_sides(spark):
    docs = K.keyword_documents(I.indexed_columns(entries(spark, ROWS)), ["title", "body", "tags"])
    found = lambda q: {r["id"] for r in K.bm25(docs, q).collect()}
    assert found("cafe") == found("café") == {"a"} and found("resume") == found("RÉSUMÉ") == {"a"} and found("é index") == {"a", "c"}
    assert found("") == set() and found("x y") == set() and found("retrieval lock") == {"a", "b"}


def test_fingerprint_tells_bags_apart(spark):
    from lorespark.operators.maintain import fingerprint

    bag = lambda *xs: tuple(fingerprint(spark.createDataFrame([(x,) for x in xs], "x string"), "x").first())
    assert bag("a", "a") != bag("b", "b") and bag("a", "b") == bag("b", "a") and bag("a") != bag(None)


@pytest.mark.parametrize("block", [4_000_000, 5])
def test_nearest_equals_brute_force_in_any_number_of_blocks(spark, monkeypatch, block):
    import itertools
    import random

    monkeypatch.setattr(V, "BLOCK_WEIGHTS", block)
    rng = random.Random(3)
    vectors = {f"v{i:02}": {rng.randrange(12): rng.uniform(-1, 1) for _ in range(4)} for i in range(30)}
    rows = spark.createDataFrame([(i, sorted(v), [v[d] for d in sorted(v)]) for i, v in vectors.items()], "id string, dims array<int>, weights array<double>")
    dot = lambda a, b: sum(w * vectors[b].get(d, 0) for d, w in vectors[a].items())
    wanted = set()
    for a in list(vectors)[:8]:
        best = sorted(((-dot(a, b), b) for b in vectors if b != a and dot(a, b) > 0.05))[:3]
        wanted |= {(a, b, r + 1) for r, (_, b) in enumerate(best)}
    got = {(r["query_id"], r["id"], r["rank"]) for r in V.nearest(rows.where("id < 'v08'"), rows, 3, 0.05, 12).collect()}
    assert got == wanted and list(itertools.islice(got, 1))
    assert V.nearest(rows.where("false"), rows, 3, 0.05, 12).isEmpty()


def test_packed_vectors_are_normalised_and_skip_unknown_tokens(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "zz", 1)], "id string, token string, tf bigint")
    vocab = V.vocabulary(counts.where("token <> 'zz'"))
    rows = {r["id"]: r for r in V.packed_vectors(counts, vocab, 2).collect()}
    assert set(rows) == {"a"} and sum(w * w for w in rows["a"]["weights"]) == pytest.approx(1) and rows["a"]["dims"] == sorted(rows["a"]["dims"])


def test_hashes_of_many_tokens_equal_those_of_one(spark):
    from lorespark.functions.hashing import fnv1a64, signed_dimension, splitmix64

    words = ["", "a", "chunking", "知识", "x" * 500, None]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", signed_dimension(8192)("t").alias("p")).collect()
    for r in rows:
        h = fnv1a64(r["t"].encode()) if r["t"] is not None else None
        assert tuple(r["p"]) == ((None, None) if h is None else (h % 8192, 1 if splitmix64(h) & 1 else -1))


def test_entries_are_created_and_superseded(spark):
    from lorespark.operators import maintain as M
    from lorespark.schema import ENTRY as SCHEMA

    now = F.lit("2025-06-01").cast("timestamp")
    drafts = spark.createDataFrame([("T", "content", "lesson", ["a"], None, "bot", 1), ("T", "content", "lesson", ["a"], None, "bot", 1), (" ", "x", "lesson", None, 0.5, None, 1), ("U", None, "lesson", None, 0.5, None, 1)], "title string, content string, kind string, tags array<string>, confidence double, source_agent string, extra int")
    made = M.created(drafts, now).collect()
    assert len(made) == 1 and made[0]["id"].startswith("mem-20250601-") and len(made[0]["id"]) == 19 and made[0]["body"] == "# T\n\ncontent" and made[0]["confidence"] == 0.5 and made[0]["path"] == f"lesson/{made[0]['id']}.md"
    assert set(M.created(drafts, now).columns) >= {f.name for f in SCHEMA.fields} - {"loaded_at"}
    t = datetime(2025, 1, 1)
    rows = spark.createDataFrame([(i, "active", None, [], ["z"], t, "kept") for i in ("o", "p", "n")] + [("q", "active", None, None, None, t, "kept")], "id string, status string, superseded_by string, supersedes array<string>, links array<string>, updated timestamp, extra string")
    pairs = spark.createDataFrame([("o", "n"), ("p", "n"), ("o", "n"), ("q", "missing"), ("q", "q"), (None, "n")], "old_id string, new_id string")
    after = {r["id"]: r for r in M.superseded(rows, pairs, now).collect()}
    assert (after["o"]["status"], after["o"]["superseded_by"]) == ("superseded", "n") and after["p"]["superseded_by"] == "n"
    assert after["n"]["supersedes"] == ["o", "p"] and after["n"]["links"] == ["z", "o", "p"] and after["n"]["status"] == "active"
    assert after["q"]["status"] == "active" and after["q"]["links"] is None and after["q"]["updated"] == t and after["n"]["updated"] > t
    assert M.superseded(rows.where("false"), pairs, now).isEmpty()
