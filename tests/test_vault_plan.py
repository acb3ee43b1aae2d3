"""The vault facade on a small calibrated corpus."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorespark.plans.vault import Vault
from lorespark.schema import ENTRY

T = datetime(2025, 1, 1)
TEXTS = {
    "a": ("Chunk size for retrieval", "Splitting prose into chunks of 512 tokens keeps retrieval recall high on long documents"),
    "b": ("Overlap between chunks", "An overlap of 64 tokens between prose chunks improves retrieval recall without longer documents"),
    "c": ("Alpine image breaks numpy", "The alpine container image has no glibc wheels so numpy builds from source and fails"),
    "d": ("Use the slim container image", "The slim container image ships glibc so numpy wheels install without builds from source"),
    "e": ("Garden watering", "Tomatoes need water every second morning during dry summers"),
    "f": ("Violin strings", "Replace gut strings before concerts because humidity detunes them"),
}


@pytest.fixture(scope="module")
def vault(spark):
    rows = [(i, "lesson", t, "active", 0.5, [f"tag{i}", "notes"], [], T, T, T, None, [], None, ["b"] if i == "a" else [], 0.0, b) for i, (t, b) in TEXTS.items()]
    return Vault(spark.createDataFrame(rows, ENTRY), F.lit("2025-01-02").cast("timestamp"))


def test_related_texts_are_far_above_the_floor_and_others_far_below(vault):
    near = {(r["id"]): r["similarity"] for r in vault.similar("a", 5, 0.0).collect()}
    assert near["b"] > 2 * 0.08 and max([v for k, v in near.items() if k != "b"], default=0) < 0.04
    assert vault.similar("c").first()["id"] == "d"


def test_search_finds_what_keywords_alone_miss(vault):
    assert vault.keyword_search("chunks prose tokens alpine").isEmpty()
    assert {r["id"] for r in vault.search("chunks prose tokens alpine", 3).collect()} == {"a", "b", "c"}


def test_graph(vault):
    graph = vault.graph().cache()
    kinds = {(r["from_id"], r["to_id"], r["kind"]) for r in graph.collect()}
    assert {("a", "b", "link"), ("a", "b", "semantic"), ("c", "d", "semantic")} <= kinds
    assert [r["id"] for r in vault.neighbours(graph, "a", 1, kinds=["link"]).collect()] == ["b"]
    assert vault.graph_summary(graph).first()["n_nodes"] == 6
    assert vault.get("a").count() == 1 and vault.list(limit=2).count() == 2 and vault.topics().count() >= 1
