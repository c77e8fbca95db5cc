"""Settings and their domains; every bound is checked when a value is set."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: name: (least, most) of numbers. Fixed values.
DOMAINS = {
    "context_tokens": (128, 32_000),
    "limit": (1, 20),
    "index_urls": (1, 50),
    "max_pages": (1, 100),
    "max_depth": (0, 3),
    "refresh_after_s": (0, 2_592_000),
    "chunk_tokens": (128, 4_000),
    "max_chunks": (1, 20),
    "rrf_k": (1, 10_000),
    "max_redirects": (0, 20),
    "scheduler_interval_s": (60, 2_592_000),
}


@dataclass(frozen=True)
class Settings:
    mode: str = "hybrid"
    context_tokens: int = 3500
    limit: int = 5
    index_urls: int = 50
    max_pages: int = 25
    max_depth: int = 1
    refresh_after_s: int = 0
    chunk_tokens: int = 500
    max_chunks: int = 3
    rrf_k: int = 60
    min_useful_chars: int = 500
    max_html_bytes: int = 5_000_000
    max_redirects: int = 5
    rerank_pool: int = 10
    rerank_protected: int = 5
    vector_dim: int = 384
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    scheduler_interval_s: int = 21_600

    def __post_init__(self):
        if self.mode not in ("bm25", "hybrid"):
            raise ValueError(f"mode must be bm25 or hybrid, not {self.mode!r}")
        for name, (least, most) in DOMAINS.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be within {least} and {most}, not {getattr(self, name)}")

    @classmethod
    def from_env(cls, env=os.environ, prefix: str = "LODESTONE_") -> Settings:
        kinds = {"int": int, "str": str}
        return cls(**{f.name: kinds[f.type](env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env})


def check_query(query: str) -> str:
    if not 1 <= len(query) <= 2000:
        raise ValueError("a query has 1 to 2000 characters")
    return query
