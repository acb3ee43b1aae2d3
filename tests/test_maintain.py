"""Maintenance of a vault."""

from datetime import datetime

from pyspark.sql import functions as F

from lorespark.operators import maintain as M

T = datetime(2025, 1, 1)


def test_import_plan(spark):
    drafts = spark.createDataFrame([("1", "New", "x", "lesson", 0.5), ("2", " held ", "x", "lesson", 0.5), ("3", "Held", "x", "lesson", 0.6), ("4", " ", "x", "lesson", 0.5), ("5", "New", None, None, None)], "draft_id string, title string, content string, kind string, confidence double")
    held = spark.createDataFrame([("b", "HELD", "lesson", 0.5), ("c", "held", "other", 0.1)], "id string, title string, kind string, confidence double")
    assert {(r[0], r[1], r[2]) for r in M.import_plan(drafts, held).collect()} == {("1", None, "create"), ("2", "b", "unchanged"), ("3", "b", "update"), ("4", None, "invalid"), ("5", None, "invalid")}


def test_last_patch_wins_and_nulls_stay(spark):
    e = spark.createDataFrame([("a", "t", 0.5, T), ("b", "u", 0.5, T)], "id string, title string, confidence double, last_verified timestamp")
    p = spark.createDataFrame([("a", datetime(2025, 2, 1), "early", 0.9), ("a", datetime(2025, 3, 1), None, 0.7), ("x", T, "lost", 0.1)], "id string, at timestamp, title string, confidence double")
    assert {tuple(r) for r in M.patched(e, p).select("id", "title", "confidence", "last_verified").collect()} == {("a", "t", 0.7, datetime(2025, 3, 1)), ("b", "u", 0.5, T)}


def test_versions_and_difference(spark):
    e = spark.createDataFrame([("n", [" o ", "o", None, ""], None), ("o", None, "n"), ("p", [], "q")], "id string, supersedes array<string>, superseded_by string")
    assert {tuple(r) for r in M.versions(e).collect()} == {("o", "n", True, True), ("p", "q", True, False)}
    a, b = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in (["1", "1", "2"], ["1", "3"]))
    assert sorted(tuple(r) for r in M.difference(a, b).collect()) == [("1", "left"), ("2", "left"), ("3", "right")]


def test_fingerprint_follows_content_not_order(spark):
    rows = [("a", None), ("b", "x"), ("c", "")]
    mark = lambda r: tuple(M.fingerprint(spark.createDataFrame(r, "id string, t string"), "id", "t").first())
    assert mark(rows) == mark(rows[::-1]) != mark([("a", ""), ("b", "x"), ("c", "")]) and mark([]) == (0, 0)


def test_lookup_review_and_snippet(spark):
    e = spark.createDataFrame([("a", "A" * 300, "one two flushes three", []), ("b", "B", "seen in src/x.py", None), ("c", "C", None, ["t"])], "id string, title string, body string, tags array<string>")
    lists = spark.createDataFrame([("l", ["b", "z", "a"]), ("m", None)], "id string, ids array<string>")
    assert [(r["place"], r["entry_id"], len(r["title"])) for r in M.looked_up(lists, e).orderBy("place").collect()] == [(0, "b", 1), (2, "a", 256)]
    assert {tuple(r) for r in M.reviewed(e).collect()} == {("a", False, 0.5, True), ("b", True, 0.65, True), ("c", False, 0.5, False)}
    assert [r[0] for r in e.orderBy("id").select(M.snippet(F.col("body"), ["flush"], 3)).collect()] == ["… two [flushes] three", None, None]
