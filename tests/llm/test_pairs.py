"""Near duplicates and similar sets against brute force, and their edge cases."""

import itertools
import random
import re

import pytest

from lorespark.llm.near_duplicates import choose_bands, near_duplicate_pairs, similar_classes
from lorespark.llm.set_joins import least_overlap, occurrences, similar_set_pairs

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
TEXT = "source_table string, id string, text string, hashes string, bands int, class_key string"


def texts(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], TEXT)


def grams(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, threshold, n):
    rows = sorted({r for r in rows if r[0] and r[1] and r[2]})
    return {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[1] != b[1] and (g := grams(a[2], n)) and (h := grams(b[2], n)) and len(g & h) >= threshold * len(g | h)}


def found(spark, rows, **kw):
    return {tuple(r) for r in near_duplicate_pairs(texts(spark, rows), **kw).collect()}


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(out))
        out[at : at + rng.randint(0, 1)] = [rng.choice("abcdefghij") * 3]
    return " ".join(out)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(10, 80))]
        rows += [(rng.choice(["x", "y"]), f"{i}-{k}", edited(rng, base)) for k in range(3)]
    for threshold, n in ((0.6, 3), (0.8, 5)):
        wanted = brute(rows, threshold, n)
        got = found(spark, rows, threshold=threshold, n=n, recall=0.999)
        assert wanted and got <= wanted and len(got) >= 0.99 * len(wanted)


def test_edge_cases_of_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [("t", "a", "one two three four"), ("t", "b", "ONE, two; three... four!"), ("t", "b", "ONE, two; three... four!"), ("u", "c", "one two three four"), ("t", "d", "one two"), ("t", "e", ""), ("t", "f", None), ("t", None, "one two three four"), (None, "g", "one two three four"), ("t", "h", "!!! ___ …"), ("t", "long1", long), ("t", "long2", long + " end"), ("t", "z1", "记忆库的条目"), ("t", "z2", "记忆库 的条目。")]
    assert found(spark, rows, threshold=0.6, n=3) == {("t", "a", "b"), ("t", "long1", "long2"), ("t", "z1", "z2")}


def test_no_rows_and_one_group_of_copies(spark):
    assert found(spark, []) == set()
    rows = [("t", f"{i:02}", "the same five words again and again") for i in range(12)]
    assert len(found(spark, rows)) == 66


def test_hot_bands_and_classes_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr("lorespark.llm.near_duplicates.BLOCK_CLASSES", 3)
    monkeypatch.setattr("lorespark.llm.pairs.BLOCK_MEMBERS", 2)
    rng = random.Random(8)
    template = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):  # variants of one template, some of them copies
        words = list(template)
        words[rng.randrange(120)] = f"v{i // 3 if i < 9 else i}"
        rows.append(("t", f"{i:02}", " ".join(words)))
    rows += [("t", f"c{i}", "all copies of one text that is short") for i in range(7)]
    wanted = brute(rows, 0.8, 3)
    got = found(spark, rows, threshold=0.8, n=3)
    assert got <= wanted and len(got) >= 0.99 * len(wanted) and len(wanted) > 400
    similar, members = similar_classes(texts(spark, rows), threshold=0.8, n=3)
    assert similar.where("class_a >= class_b").isEmpty() and similar.count() == similar.distinct().count() and members.count() == len(rows)


def test_bands_reach_the_recall_with_no_band_to_spare():
    for t, r in ((0.6, 4), (0.8, 5)):
        b = choose_bands(t, 0.99, r)
        assert 1 - (1 - t**r) ** b >= 0.99 > 1 - (1 - t**r) ** (b - 1)


def test_occurrences_equal_counting():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 50))) for _ in range(rng.randint(0, 8))]
        least = rng.randint(1, 8)
        count = {v: sum(v in x for x in lists) for v in range(60)}
        assert list(occurrences(lists, least)) == [(v, c) for v, c in sorted(count.items()) if c >= least]


def sets(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "field_name string, id string, values array<string>, class_key string, side int")


def brute_sets(a, b, threshold, least):
    clean = lambda rows: {(f, i, frozenset(x for x in v if x is not None)) for f, i, v in rows if f and i and v is not None}
    return {(f, i, j) for f, i, s in clean(a) for g, j, t in clean(b) if f == g and len(s) >= least and len(t) >= least and len(s & t) >= threshold * len(s | t)}


@pytest.mark.parametrize("threshold", [0.34, 0.6, 1.0])
def test_similar_sets_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr("lorespark.llm.set_joins.BLOCK", 3)  # popular values are split into many blocks
    monkeypatch.setattr("lorespark.llm.pairs.BLOCK_MEMBERS", 2)
    rng = random.Random(4)
    rows = [(rng.choice("fg"), f"{i:03}", [rng.choice("abcdefghijklmnop" if i % 2 else "ab" * 8 + "cdef") for _ in range(rng.randint(0, 9))]) for i in range(150)]
    got = {tuple(r) for r in similar_set_pairs(sets(spark, rows), threshold, 2).collect()}
    assert got == {(f, i, j) for f, i, j in brute_sets(rows, rows, threshold, 2) if i < j}
    left, right = rows[:70], rows[70:] + [("f", "000", ["a", "b", "c"])]
    got = {tuple(r) for r in similar_set_pairs(sets(spark, left), threshold, 2, other=sets(spark, right)).collect()}
    assert got == brute_sets(left, right, threshold, 2)


def test_edge_cases_of_sets(spark):
    rows = [("f", "a", ["x", "y", "z", "x", None]), ("f", "b", ["z", "y", "x"]), ("f", "b", ["z", "y", "x"]), ("g", "c", ["x", "y", "z"]), ("f", "d", []), ("f", "e", None), ("f", "h", [None, None, None]), (None, "i", ["x", "y", "z"]), ("f", None, ["x", "y", "z"]), ("f", "j", ["x", "y"])]
    assert {tuple(r) for r in similar_set_pairs(sets(spark, rows)).collect()} == {("f", "a", "b")}
    assert similar_set_pairs(sets(spark, [])).isEmpty()
    with pytest.raises(ValueError):
        similar_set_pairs(sets(spark, rows), threshold=0)


def test_least_overlap():
    assert [least_overlap(3, 3, 0.6), least_overlap(3, 4, 0.6), least_overlap(5, 5, 0.6), least_overlap(4, 4, 1.0)] == [3, 3, 4, 4]
