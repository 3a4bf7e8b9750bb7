"""Settings of a review, read on the driver; keys that are unknown are left out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Review:
    """Limits unless a file sets others."""

    max_diff_chars: int = 120_000
    depth: int = 3
    backend_depth: int = 4
    callers_per_symbol: int = 5
    callers_in_all: int = 20
    search_hits: int = 20
    min_risk: str = "medium"


@dataclass(frozen=True)
class Privacy:
    redact_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    review: Review = field(default_factory=Review)
    privacy: Privacy = field(default_factory=Privacy)


def parse_config(text: str) -> Config:
    """From JSON, or YAML where a YAML library is installed; an empty text gives the defaults."""
    try:
        raw = json.loads(text or "{}")
    except ValueError:
        import yaml

        raw = yaml.safe_load(text) or {}
    made = {}
    for f in fields(Config):
        kind = {"review": Review, "privacy": Privacy}[f.name]
        own = raw.get(f.name) or {}
        known = {k.name for k in fields(kind)}
        made[f.name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in known})
    return Config(**made)
