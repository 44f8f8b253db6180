"""Tunable defaults of the engine, overridable from the environment (``HOPSPARK_<NAME>``)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_words: int = 500
    chunk_overlap: int = 50
    top_k: int = 20
    seed_k: int = 3
    final_k: int = 20
    oversample: int = 3
    expansions_per_seed: int = 3
    max_entity_degree: int = 8
    bridge_relation: str = "addresses_subtopic"
    bridge_threshold: float = 0.55
    bridge_top_n: int = 3
    bridge_max: int = 2
    resolve_threshold: float = 0.87
    rerank_top_n: int = 20
    max_per_paper: int = 2
    synthesis_top_n: int = 5
    min_overlap: float = 0.4
    judge_threshold: float = 0.5
    relevance_gate: float = -2.0
    score_k: int = 5
    max_sub_questions: int = 1

    @classmethod
    def from_env(cls) -> Settings:
        """Defaults, with any variable of a field's name taking precedence; others are ignored."""
        kinds = {"int": int, "float": float, "str": str}
        given = {f.name: kinds[f.type](v) for f in fields(cls) if (v := os.environ.get(f"HOPSPARK_{f.name.upper()}")) is not None}
        return cls(**given)


DEFAULTS = Settings()
