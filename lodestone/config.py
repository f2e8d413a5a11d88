"""Parameters of ingest, search and evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodestone.errors import SEARCH_INVALID, EngineError


@dataclass(frozen=True)
class ChunkSettings:
    chunk_size: int = 1000
    max_chunk_size: int = 8000
    overlap_ratio: float = 0.10
    heading_depth: int = 5
    paragraph_min: int = 200
    min_chunk_size: int = 256
    custom_separator: str | None = None

    def __post_init__(self) -> None:
        for name in ("chunk_size", "max_chunk_size", "min_chunk_size"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        object.__setattr__(self, "overlap_ratio", min(0.5, max(0.0, self.overlap_ratio)))


@dataclass(frozen=True)
class SearchConfig:
    """``token_budget``, ``parent_window`` and so on: 0 or None switches a stage off."""

    top_k: int = 10
    score_threshold: float | None = None
    threshold_mode: str = "mixed"
    use_rerank: bool = True
    rerank_weight: float = 0.5
    rrf_k: int = 60
    vector_weight: float = 0.7
    fulltext_weight: float = 0.3
    max_variants: int = 3
    query_extension: bool = True
    select_alpha: float = 0.3
    token_budget: int = 960_000
    parent_window: int = 0
    parent_decay: float = 0.5

    def __post_init__(self) -> None:
        if isinstance(self.top_k, bool) or not isinstance(self.top_k, int) or self.top_k <= 0:
            raise EngineError(SEARCH_INVALID, "top_k must be a positive integer")
        if min(self.vector_weight, self.fulltext_weight) < 0:
            raise EngineError(SEARCH_INVALID, "weights must not be negative")
        if not 0 <= self.parent_decay <= 1:
            raise EngineError(SEARCH_INVALID, "parent_decay must lie between 0 and 1")


@dataclass(frozen=True)
class EvalConfig:
    metrics: tuple[str, ...] = ("recall", "precision", "hit_rate", "mrr", "ndcg")
    generation_metrics: tuple[str, ...] = ("faithfulness", "answer_relevance", "context_precision")
    default_k: int = 10
    backend: str = "naive"
    thresholds: dict[str, float] = field(default_factory=dict)
    max_regression: float | None = None
