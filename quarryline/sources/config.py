"""Settings of a build from a TOML file; unknown keys are ignored."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass
class BuildConfig:
    months: int = 12
    half_life_days: float = 180.0
    max_files_per_commit: int = 50
    min_shared_commits: float = 3.0
    min_confidence: float = 0.25
    formats: tuple[str, ...] = ("agents_md", "report")

    @classmethod
    def load(cls, path: str) -> BuildConfig:
        file = Path(path)
        read = tomllib.loads(file.read_text()) if file.exists() else {}
        flat = {k: v for part in (read, *(v for v in read.values() if isinstance(v, dict))) for k, v in part.items()}
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in known})


def months_of(since: str | None) -> int | None:
    """'6m' is 6; anything else is nothing."""
    return int(since[:-1]) if since and since[:-1].isdigit() and since.endswith("m") else None
