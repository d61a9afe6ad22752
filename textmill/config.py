"""Settings of the engine in one place. Nothing reads the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults of retrieval, chunking, gates and memory. Sizes are characters."""

    # Fixed values of the query semantics.
    top_k: int = 8
    pool_factor: int = 3
    rrf_k: int = 60
    merge_threshold: int = 2
    evidence_chars: int = 12_000
    item_overhead: int = 120
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    near_bits: int = 3
    section_chars: int = 1_800
    chunk_sizes: tuple[tuple[int, int], ...] = ((2400, 400), (1600, 200), (800, 100))
    answerable: float = 0.5
    ambiguous: float = 0.12
    coverage: float = 0.5
    focus_coverage: float = 0.5
    focus_terms: int = 12
    cited_support: float = 0.3
    uncited_support: float = 0.5
    free_chars: int = 12
    cache_threshold: float = 0.93
    cache_ttl_s: int = 24 * 3600
    turns: int = 8
    episode_ttl_s: int = 30 * 24 * 3600
    support_floor: float = 0.6
    noise_points: float = 3.0
    auto_samples: int = 200


DEFAULT = Config()
