"""Settings with their ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class GraphConfig:
    """Knobs of the graph; :meth:`validate` raises ValueError for a value out of range."""

    dimensions: int = 8192
    semantic_top_k: int = 8
    semantic_min_similarity: float = 0.08
    tag_min_jaccard: float = 0.34
    corroborate_min_similarity: float = 0.15
    max_edges_per_node: int = 24

    def validate(self) -> GraphConfig:
        ranges = {"dimensions": (256, 65536), "semantic_top_k": (1, 64), "semantic_min_similarity": (0, 1), "tag_min_jaccard": (0, 1), "corroborate_min_similarity": (0, 1), "max_edges_per_node": (1, 512)}
        for f in fields(self):
            low, high = ranges[f.name]
            if not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must be within {low} and {high}")
        return self


def relation_kinds(text: str) -> list[str]:
    """The kinds of a comma-separated list, each once; an unknown one is a ValueError."""
    from lorespark.operators.edges import KIND_ORDER

    kinds = list(dict.fromkeys(k.strip() for k in text.split(",") if k.strip()))
    if unknown := [k for k in kinds if k not in KIND_ORDER]:
        raise ValueError(f"unknown kinds: {', '.join(unknown)}")
    return kinds
