"""Settings from the environment, with bounds; plain Python on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from corvane.operators.ingest import IngestConfig
from corvane.operators.rank import RetrievalConfig

#: Default, least and most of each number (None: no bound).
BOUNDS = {
    "chunk_max_chars": (1100, 200, None), "chunk_overlap": (1, 0, 3), "min_content_chars": (400, 0, None), "top_k": (8, 1, 30), "candidate_pool": (40, 5, None),
    "per_ticker_k": (4, 1, 10), "max_chunks_per_article": (2, 1, 5), "rrf_k": (60, 1, None), "min_query_coverage": (0.60, 0.0, 1.0), "min_anchored_coverage": (0.20, 0.0, 1.0),
    "min_articles_for_filter": (2, 1, None), "lsa_components": (128, 8, None), "llm_max_tokens": (900, 100, 4000), "history_max_messages": (8, 0, 30),
}
#: Model providers in the order in which "auto" tries them, and the variables that hold their keys.
PROVIDERS = {"anthropic": ["ANTHROPIC_API_KEY"], "gemini": ["GEMINI_API_KEY", "GOOGLE_API_KEY"], "openrouter": ["OPENROUTER_API_KEY"]}


@dataclass(frozen=True)
class Settings:
    numbers: dict[str, float]
    provider: str
    log_level: str = "INFO"
    log_json: bool = False

    def ingest(self) -> IngestConfig:
        n = self.numbers
        return IngestConfig(int(n["chunk_max_chars"]), int(n["chunk_overlap"]), int(n["min_content_chars"]))

    def retrieval(self) -> RetrievalConfig:
        n = self.numbers
        return RetrievalConfig(int(n["top_k"]), int(n["candidate_pool"]), int(n["per_ticker_k"]), int(n["max_chunks_per_article"]), int(n["rrf_k"]), n["min_query_coverage"], n["min_anchored_coverage"], int(n["min_articles_for_filter"]))


def provider(choice: str, env: Mapping[str, str]) -> str:
    """The provider to use: choice if it has a key (an error if not), or for "auto" the first that has one; "extractive" else."""
    keyed = [p for p, names in PROVIDERS.items() if any(env.get(n) for n in names)]
    if choice in PROVIDERS and choice not in keyed:
        raise ValueError(f"provider {choice} has no key; set {' or '.join(PROVIDERS[choice])}")
    return choice if choice != "auto" else keyed[0] if keyed else "extractive"


def settings(env: Mapping[str, str] | None = None, prefix: str = "CORVANE_") -> Settings:
    env = os.environ if env is None else env
    numbers: dict[str, float] = {}
    for name, (default, least, most) in BOUNDS.items():
        value = type(default)(env.get(prefix + name.upper(), default))
        if (least is not None and value < least) or (most is not None and value > most):
            raise ValueError(f"{name} must be in {least}..{'' if most is None else most}, not {value}")
        numbers[name] = value
    return Settings(numbers, provider(env.get(prefix + "LLM_PROVIDER", "auto"), env), env.get(prefix + "LOG_LEVEL", "INFO"), env.get(prefix + "LOG_JSON", "").lower() in ("1", "true", "yes"))


