"""Settings of an engine, from keywords or TOML; tables of a session are passed beside it."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class UsageConfig:
    enabled: bool = True
    max_entries: int = 10_000
    max_boost: float = 0.08


@dataclass(frozen=True)
class ContentConfig:
    enabled: bool = True
    engine: str = "auto"
    allow_slow_fallback: bool = False
    in_work_tree: bool = False


@dataclass(frozen=True)
class Config:
    """What to index, where to keep it, and how to search it. Unknown keys of a file are ignored, missing ones take defaults."""

    index_roots: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    respect_ignore_files: bool = True
    index_path: str = "index"
    reconcile_hour: int = 3
    usage: UsageConfig = field(default_factory=UsageConfig)
    content: ContentConfig = field(default_factory=ContentConfig)

    def __post_init__(self):
        if not 0 <= self.reconcile_hour <= 23:
            raise ValueError("reconcile_hour is an hour of the day")

    @classmethod
    def load(cls, path: str) -> Config:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        known = lambda kind, values: kind(**{f.name: tuple(v) if isinstance(v := values[f.name], list) else v for f in fields(kind) if f.name in values})
        for name, kind in (("usage", UsageConfig), ("content", ContentConfig)):
            if name in raw:
                raw[name] = known(kind, raw[name])
        return known(cls, raw)
