"""Settings with the defaults and ranges that change results."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields, replace

STRATEGIES = ("dense", "sparse", "mmr", "ensemble")
CHUNKERS = ("recursive", "semantic", "section_aware")


@dataclass(frozen=True)
class EngineConfig:
    """Every field can be set by keyword or by an environment variable of its name in upper case."""

    chunk_size: int = 1000
    chunk_overlap: int = 200
    chunking_strategy: str = "section_aware"
    retrieval_top_k: int = 5
    retrieval_score_threshold: float = 0.3
    retrieval_strategy: str = "ensemble"
    mmr_diversity_score: float = 0.3
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    confidence_threshold: float = 0.7
    enable_hallucination_check: bool = True
    enable_numerical_validation: bool = True
    embedding_provider: str = "hashed"
    embedding_dimension: int = 64
    llm_provider: str = "extractive"
    llm_temperature: float = 0.1
    llm_max_tokens: int = 4096
    requests_per_second: float = 10.0
    log_level: str = "INFO"
    vocabulary: str = ""

    def __post_init__(self) -> None:
        def within(name: str, low: float, high: float = float("inf")) -> None:
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be within {low} and {high}")

        within("chunk_size", 100, 10_000)
        within("chunk_overlap", 0)
        within("retrieval_top_k", 1, 100)
        within("llm_temperature", 0, 2)
        within("llm_max_tokens", 1)
        within("embedding_dimension", 1)
        for name in ("retrieval_score_threshold", "mmr_diversity_score", "dense_weight", "sparse_weight", "confidence_threshold"):
            within(name, 0, 1)
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")
        if self.retrieval_strategy not in STRATEGIES or self.chunking_strategy not in CHUNKERS:
            raise ValueError("unknown strategy")
        if self.log_level.upper() not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ValueError("unknown log level")

    def missing_keys(self) -> list[str]:
        """The environment variables that the chosen back ends need and that are not set; the built-in ones need none."""
        needed = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}
        return sorted({needed[p] for p in (self.embedding_provider, self.llm_provider) if p in needed and not os.environ.get(needed[p])})

    def configure_logging(self) -> logging.Logger:
        """The package's logger at ``log_level``."""
        logger = logging.getLogger("docsight")
        logger.setLevel(self.log_level.upper())
        return logger

    @classmethod
    def from_environment(cls, **given) -> EngineConfig:
        read = {}
        for f in fields(cls):
            text = os.environ.get(f.name.upper())
            if text is not None:
                kind = type(f.default)
                read[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        return replace(cls(), **{**read, **given})
