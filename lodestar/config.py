"""Settings of the engine, with their defaults."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Limits of ingestion and budgets of retrieval."""

    max_repository_bytes: int = 80 * 1024 * 1024
    max_file_bytes: int = 1_500_000
    max_zip_files: int = 20_000
    dense_top_k: int = 20
    lexical_top_k: int = 20
    symbol_top_k: int = 20
    rerank_top_k: int = 12
    graph_depth: int = 2
    graph_limit: int = 24
    context_chars: int = 24_000
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    rrf_k: int = 60
    index_non_source: bool = True
    embedding_provider: str = "sha256"
    embedding_batch_texts: int = 256
    embedding_batch_bytes: int = 1 << 20
    vector_lists: int = 0
    vector_probes: int = 0
    segment_fan: int = 4
    stuck_after: str = "1 day"
    report_replicates: int = 1000

    @classmethod
    def load(cls, path: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "LODESTAR_") -> EngineConfig:
        """Defaults, what a JSON file has of them, and what the environment has under the prefix, the last one first."""
        given = {}
        if path:
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
        for name, value in (os.environ if environment is None else environment).items():
            if name.startswith(prefix):
                given[name.removeprefix(prefix).lower()] = value
        known = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"no such settings: {', '.join(unknown)}")
        return cls(**{k: _as(known[k], v) for k, v in given.items()})


def _as(kind: str, value: object) -> object:
    """A value of a setting's type; texts of yes and no are booleans."""
    if kind == "bool" and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "bool": bool, "str": str}[kind](value)


DEFAULT = EngineConfig()
