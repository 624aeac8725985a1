"""Configuration from YAML: a mapping of known keys, checked."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Analysis:
    max_chunk_characters: int = 24_000
    include_provider_in_fingerprint: bool = False
    language: str = "auto"

    def __post_init__(self):
        if not 128 <= self.max_chunk_characters <= 1_000_000:
            raise ValueError("max_chunk_characters is out of range")


@dataclass(frozen=True)
class Model:
    provider: str = "local"
    model: str = ""
    base_url: str | None = None
    requests_per_minute: int = 20
    max_concurrency: int = 2
    default_max_output_tokens: int = 4096
    timeout_seconds: float = 60

    def __post_init__(self):
        if min(self.requests_per_minute, self.max_concurrency, self.default_max_output_tokens, self.timeout_seconds) <= 0:
            raise ValueError("limits must be positive")


@dataclass(frozen=True)
class Config:
    analysis: Analysis = field(default_factory=Analysis)
    model: Model = field(default_factory=Model)
    plan_ttl_minutes: int = 30
    cards_folder: str = "Cards"
    books_folder: str = "Books"


def from_mapping(values: Any, kind: type = Config):
    if not isinstance(values, dict):
        raise ValueError("the root must be a mapping")
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    nested = {"analysis": Analysis, "model": Model}
    return kind(**{k: from_mapping(v, nested[k]) if k in nested and kind is Config else v for k, v in values.items()})


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})
