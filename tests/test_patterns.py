"""Patterns keep every member."""

from lorespark.operators import claims


def test_all_members_come_out_in_order(spark):
    rows = [(f"e{i}", f"t{9 - i}", "active", ["hot", "s:x"]) for i in range(8)] + [("x", "t", "archived", ["hot"]), ("y", "t", "active", ["rare"])]
    got = claims.pattern_members(spark.createDataFrame(rows, "id string, title string, status string, tags array<string>"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(("hot", f"e{i}", f"t{9 - i}", 8 - i) for i in range(8))
