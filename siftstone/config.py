"""Engine settings: defaults, overridden by environment variables of the same name in capitals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


def _flag(value: str) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on")


class MissingKey(ValueError):
    """A hosted provider is configured, but its key is not in the environment."""


#: Where hosted providers' keys are; providers that are not named need none.  Fixed values.
KEYS = {"openai": "OPENAI_API_KEY", "google": "GOOGLE_API_KEY"}


@dataclass(frozen=True)
class EngineConfig:
    """Every knob of the engine.  ``mmr_lambda`` 1 means no diversity; ``citation_mode`` is auto, model or off."""

    embed_provider: str = "hashing"
    chat_provider: str = "extractive"
    embedding_model: str = "hashing-64"
    embed_dim: int = 64
    embed_normalize: bool = True
    chunk_size: int = 1000
    chunk_overlap: int = 150
    min_chunk_chars: int = 80
    context_headers: bool = True
    top_k: int = 5
    fetch_k: int = 20
    mmr_lambda: float = 1.0
    use_hybrid: bool = True
    weight_dense: float = 0.6
    weight_sparse: float = 0.4
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    rrf_c: int = 60
    embed_batch_size: int = 64
    embed_max_retries: int = 8
    embed_rpm: int = 0
    embed_cache: bool = True
    max_history_turns: int = 6
    citation_mode: str = "auto"
    cite_threshold: float = 0.55
    cite_min_chars: int = 40
    snippet_chars: int = 300
    min_page_chars: int = 200
    data_dir: str = "data"
    index_dir: str = "index"
    embed_cache_dir: str = ".embed_cache"

    def __post_init__(self) -> None:
        if self.citation_mode not in ("auto", "model", "off"):
            raise ValueError(f"citation_mode {self.citation_mode!r}: auto, model or off")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        """Blank values count as unset."""
        env = os.environ if env is None else env
        parse = {"int": int, "float": float, "bool": _flag, "str": str}
        return cls(**{f.name: parse[str(f.type)](env[f.name.upper()]) for f in fields(cls) if env.get(f.name.upper(), "").strip()})

    @staticmethod
    def check_key(provider: str, env: Mapping[str, str] | None = None) -> None:
        """Fails before any work if ``provider`` needs a key that is not there."""
        name = KEYS.get(provider)
        if name and not (os.environ if env is None else env).get(name, "").strip():
            raise MissingKey(f"{provider} needs {name} in the environment")

    def summary(self) -> str:
        """One line for logs."""
        ranking = f"hybrid {self.weight_dense:g}/{self.weight_sparse:g}" if self.use_hybrid else "dense"
        return f"embeddings {self.embed_provider}:{self.embedding_model}, answers {self.chat_provider}, chunks {self.chunk_size}/{self.chunk_overlap}, top {self.top_k}, {ranking}, mmr {self.mmr_lambda:g}"
