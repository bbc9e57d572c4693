"""Settings with their defaults, read from YAML or JSON; a missing file gives the defaults."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Embedding:
    provider: str = "auto"
    model: str = ""
    base_url: str = ""
    api_key: str = ""
    dimension: int = 0


@dataclass(frozen=True)
class Episodic:
    chunk_sentences: int = 3
    chunk_overlap: int = 1
    default_top_k: int = 10


@dataclass(frozen=True)
class Index:
    temporal_decay: float = 0.01
    reinforcement_weight: float = 0.1
    confidence_default: float = 1.0
    ivf_threshold: int = 10_000
    partitions: int = 64


@dataclass(frozen=True)
class Semantic:
    max_traversal_depth: int = 2
    decay: float = 0.005
    min_confidence: float = 0.05
    extraction_mode: str = "embedding"


@dataclass(frozen=True)
class Retrieval:
    token_budget: int = 4000
    episodic_weight: float = 0.4
    semantic_weight: float = 0.3
    explicit_weight: float = 0.2
    behavioral_weight: float = 0.1


@dataclass(frozen=True)
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    episodic: Episodic = field(default_factory=Episodic)
    index: Index = field(default_factory=Index)
    semantic: Semantic = field(default_factory=Semantic)
    retrieval: Retrieval = field(default_factory=Retrieval)
    data_dir: str = "./data"

    @classmethod
    def of(cls, given: dict) -> Config:
        """From nested mappings; names that no setting has are an error."""
        kinds = {f.name: f.default_factory for f in dataclasses.fields(cls) if f.default_factory is not dataclasses.MISSING}
        unknown = set(given) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: kinds[k](**(v or {})) if k in kinds else v for k, v in given.items()})

    @classmethod
    def read(cls, path: str | Path) -> Config:
        p = Path(path)
        if not p.exists():
            return cls()
        text = p.read_text(encoding="utf-8")
        if p.suffix == ".json":
            return cls.of(json.loads(text or "{}"))
        import yaml  # only where such a file is read

        return cls.of(yaml.safe_load(text) or {})
