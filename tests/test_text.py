"""Text, score and hashing functions."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from lorespark.functions import hashing, text
from lorespark.functions.scores import effective_confidence


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("The chunks of policies, uses", ["chunk", "of", "policy"]),
        ("class ties a 7 v2.0", ["class", "ties", "7", "v2", "0"]),
        ("存储库 ok", ["存", "储", "库", "存储", "储库", "ok"]),
        ("", []),
        (None, None),
        ("cafés", ["caf"]),
    ],
)
def test_tokens(spark, given, wanted):
    assert one(spark, text.tokens(F.col("x")), given) == wanted


def test_stop_word_list_has_its_fixed_length():
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 81


@pytest.mark.parametrize(("given", "positive", "negative"), [("It works, is reliable and proven", 3, 0), ("validate against it", 0, 0), ("This fails and does not help; avoided", 0, 3), ("Uses used using", 1, 0), ("", 0, 0)])
def test_markers(spark, given, positive, negative):
    assert one(spark, text.marker_count(F.col("x"), text.POSITIVE_MARKERS), given) == positive
    assert one(spark, text.marker_count(F.col("x"), text.NEGATIVE_MARKERS), given) == negative


@pytest.mark.parametrize(("given", "wanted"), [("Vault layout — details", "Vault layout"), ("notes", None), ("one two three four five six seven", None), ("a: two three four five six seven", "a: two three four five six seven"), ("ab", None)])
def test_title_subject(spark, given, wanted):
    assert one(spark, text.title_subject(F.col("x")), given) == wanted


def test_title_tokens(spark):
    assert one(spark, text.title_tokens(F.col("x")), "Publication-figure notes 123 记忆库") == ["publication-figure", "publication", "figure", "记忆", "忆库"]


def test_slug_and_excerpt(spark):
    assert one(spark, text.slug(F.col("x")), "  Hello, World! ") == "hello-world"
    assert one(spark, text.slug(F.col("x")), "记忆") == "entry"
    assert one(spark, text.excerpt(F.col("x"), 8), "# Title\n\nsome  long\ntext") == "some lon…"


def test_effective_confidence(spark):
    rows = spark.sql("SELECT 0.8D confidence, 0.05D decay_rate, timestamp'2024-01-01' last_verified, CAST(NULL AS timestamp) expires UNION ALL SELECT 0.8D, 0.05D, timestamp'2024-01-01', timestamp'2024-06-01' UNION ALL SELECT 0.8D, 0.05D, timestamp'2030-01-01', NULL UNION ALL SELECT NULL, 0.05D, timestamp'2024-01-01', NULL")
    got = [r[0] for r in rows.select(effective_confidence(F.lit("2025-01-01").cast("timestamp"))).collect()]
    assert got[0] == pytest.approx(0.8 * 2.718281828459045 ** (-0.05 * 366 * 86400 / 31557600), rel=1e-12)
    assert got[1:] == [0.0, 0.8, None]


def test_hashes(spark):
    assert hashing.fnv1a64(b"") == 0xCBF29CE484222325
    assert hashing.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert hashing.splitmix64(0) == 0xE220A8397B1DCDAF
    row = spark.createDataFrame([(["a", None], 0.5)], "p array<string>, c double").select(hashing.content_hash("p", "c")).first()[0]
    assert row == hashlib.sha256(b"a\0\0" + struct.pack("<d", 0.5)).hexdigest()
