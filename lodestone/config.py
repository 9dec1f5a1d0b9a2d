"""Effective parameters of retrieval and indexing, in one frozen record."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    dense_weight: float = 0.6
    sparse_weight: float = 0.25
    meta_weight: float = 0.15
    experiment_sparse_weight: float = 0.4
    candidates_per_k: int = 20
    experiment_candidates: int = 200
    stages: tuple[int, int, int] = (500, 200, 50)
    ks: tuple[int, ...] = (1, 5, 10, 50)
    ivf_probe: int = 16
    pq_parts: int = 8
    pq_bits: int = 8
    graph_links: int = 16
    graph_build_beam: int = 200
    graph_search_beam: int = 50
    graph_level_scale: float = 0.5
    lsh_tables: int = 10
    lsh_bits: int = 16
    forest_trees: int = 10
    context_items: int = 5
    min_caption_chars: int = 5
    validation_share: float = 0.2
    test_share: float = 0.1
    seed: int = 42
    generator_model: str = field(default_factory=lambda: os.environ.get("LLM_MODEL", "template"))
    generator_url: str = field(default_factory=lambda: os.environ.get("LLM_BASE_URL", ""))
    encoder_model: str = field(default_factory=lambda: os.environ.get("CLIP_MODEL_NAME", "hashing"))

    @property
    def weights(self) -> tuple[float, float, float]:
        return self.dense_weight, self.sparse_weight, self.meta_weight


DEFAULT = Config()


def lists_for(n: int) -> int:
    """Inverted lists for n vectors."""
    return max(10, min(n // 40, 400))


def trees_for(n: int) -> int:
    """Trees of a forest over n vectors."""
    return min(50, n // 20 + 10)
