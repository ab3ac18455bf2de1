"""Layered settings: defaults, then a TOML file, then the environment (FOLIOSCOPE_<NAME>)."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    candidate_source_limit: int = 120
    candidate_pool: int = 50
    verifier_candidates: int = 20
    top_k: int = 10
    chunk_target_tokens: int = 420
    chunk_overlap_tokens: int = 63
    chat_hypotheses: int = 2
    chat_global_k: int = 2
    chat_local_k: int = 5
    chat_candidates: int = 16
    chat_text_chars: int = 1800
    job_retention_seconds: int = 1800


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Unknown keys are ignored; values take the type of the default."""
    values: dict[str, object] = {}
    if path and Path(path).exists():
        values |= tomllib.loads(Path(path).read_text())
    env = os.environ if env is None else env
    out = {}
    for f in dataclasses.fields(Settings):
        raw = env.get("FOLIOSCOPE_" + f.name.upper(), values.get(f.name, f.default))
        out[f.name] = type(f.default)(raw)
    return Settings(**out)
