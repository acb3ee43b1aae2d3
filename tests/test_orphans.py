"""References to records that do not exist."""

import random
from datetime import datetime, timedelta

import pytest

from lorespark.operators.orphans import matched_targets, orphan_references, orphan_report, vault_references

T0 = datetime(2025, 1, 31, 23, 0)
ENTRY = "id string, updated timestamp, loaded_at timestamp, supersedes array<string>, superseded_by string, links array<string>, target_id string, series string"
QUEUE = "id string, updated_at timestamp, loaded_at timestamp, candidate struct<distillation:struct<related_entry_ids:array<string>>>"


def entries(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ENTRY)


def queue(spark, rows=()):
    return spark.createDataFrame(list(rows), QUEUE)


def removals(spark, rows=()):
    return spark.createDataFrame(list(rows), "entry_id string, removed_at timestamp, reason string")


def found(spark, e, q=(), r=()):
    e = entries(spark, e)
    refs = vault_references(e, queue(spark, q))
    return {tuple(x) for x in orphan_references(refs, e.select("id", "loaded_at"), removals(spark, r)).collect()}


def matched(spark, targets, parents, removed=()):
    at = lambda ids: spark.createDataFrame([(i, T0) for i in ids], "target_id string, at timestamp")
    asked = spark.createDataFrame([(t, 1) for t in targets], "target_id string, extra int")
    return {r["target_id"]: r for r in matched_targets(asked, at(parents), at(removed)).collect()}


@pytest.mark.parametrize("partitions", [1, 3])
def test_known_ids_without_an_unknown_target_between_are_one_run(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = matched(spark, ["m-02", "m-77", "m-50", "m-ff", "a-01"], ["m-01", "m-02", "m-09", "m-77", "m-80"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {t for t, r in rows.items() if r["known"]} == {"m-02", "m-77"}
    if partitions == 1:  # runs end at the borders of partitions
        assert {t: r["run_ids"] for t, r in rows.items()} == {"m-02": 2, "m-50": 3, "m-77": 1, "m-ff": 2, "a-01": 0}


def test_asof_match_tells_ids_of_other_width_or_series_apart(spark):
    asked = ["m-01", "m-02", "m-03", "m-1", "m-001", "n-04", "n-05", "xyz", "xyw", "", "m-" + "f" * 40]
    rows = matched(spark, asked, ["m-01", "m-02", "n-05", "xyz"], ["m-03", "m-02"])
    assert {t for t, r in rows.items() if r["known"]} == {"m-01", "m-02", "n-05", "xyz"}
    assert {t for t, r in rows.items() if r["removed_at"] is not None} == {"m-02", "m-03"}
    assert {t for t, r in rows.items() if r["target_loaded_at"] is not None} == {t for t, r in rows.items() if r["known"]}


def test_matching_across_batches_equals_sets(spark):
    rng = random.Random(5)
    every = [f"{rng.choice('xyz')}-{rng.randint(0, 4000):04x}" for _ in range(3000)]
    parents, asked, removed = (set(rng.sample(every, 1200)) for _ in range(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = matched(spark, asked, parents, removed)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(rows) == asked and {t for t, r in rows.items() if r["known"]} == asked & parents
    assert {t for t, r in rows.items() if r["removed_at"] is not None} == asked & removed


def test_reasons_in_their_order(spark):
    late = T0 + timedelta(days=3)
    e = [
        ("a-1", T0, T0, [" a-9 ", "a-9", "", None, "a-2"], None, ["a-3", "a-4"]),
        ("a-2", T0, late, None, " a-1", []),
        ("a-3", T0, T0, [], "  ", None),
    ]
    gone = [("a-3", T0, None), ("a-4", T0 + timedelta(days=1), "x"), ("a-4", None, "x")]
    assert found(spark, e, r=gone) == {
        ("entries", "a-1", "supersedes", "a-9", "missing", "2025-01"),
        ("entries", "a-1", "supersedes", "a-2", "late", "2025-01"),
        ("entries", "a-1", "links", "a-3", "deleted", "2025-01"),
        ("entries", "a-1", "links", "a-4", "missing", "2025-01"),
    }


def test_copies_count_once_with_the_earliest_load(spark):
    later = T0 + timedelta(days=9)
    e = [("b-1", T0, later, None, None, ["b-2"]), ("b-1", T0, T0, None, None, ["b-2"]), ("b-2", T0, later, None, None, None), ("b-2", T0, T0, None, None, None)]
    q = [("q", T0, T0, ((["b-7", "b-7 "],),)), ("q", T0, later, ((["b-7", "b-7 "],),)), ("r", None, None, None), (None, T0, T0, ((["b-8"],),))]
    assert found(spark, e, q) == {("queue_items", "q", "related_entry_ids", "b-7", "missing", "2025-01")}


def test_null_times(spark):
    e = [("c-1", None, None, None, None, ["c-2", "c-3"]), ("c-2", T0, T0, None, None, None)]
    assert found(spark, e, r=[("c-2", T0, None)]) == {("entries", "c-1", "links", "c-3", "missing", None)}


def test_empty_tables_and_report(spark):
    assert found(spark, []) == set()
    e = entries(spark, [("d-1", T0, T0, ["x"], "x", ["x", "y"])])
    rows = orphan_report(orphan_references(vault_references(e, queue(spark)), e.select("id", "loaded_at"), removals(spark))).collect()
    assert {(r["field_name"], r["n_references"], r["n_records"], r["n_targets"]) for r in rows} == {("supersedes", 1, 1, 1), ("superseded_by", 1, 1, 1), ("links", 2, 1, 2)}
