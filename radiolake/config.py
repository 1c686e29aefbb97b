"""Settings of a run: nested frozen dataclasses, read from JSON (or YAML, if a reader is
installed) and overlaid on a base file key by key."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .runtime import fetch


@dataclass(frozen=True)
class Data:
    root: str = "data"
    split: str = "train"
    combine: bool = False
    target_size: tuple[int, int] = (1024, 512)
    holdout_fraction: float = 0.2
    folds: int = 5
    parquet_cache: bool = True


@dataclass(frozen=True)
class Model:
    name: str = ""
    load_in_4bit: bool = True
    max_new_tokens: int = 512


@dataclass(frozen=True)
class Weights:
    accuracy: float = 1.0
    format: float = 0.2
    tool_validity: float = 0.2
    efficiency: float = 0.1
    judge: float = 0.0


@dataclass(frozen=True)
class Adapter:
    r: int = 16
    alpha: int = 32
    dropout: float = 0.05


@dataclass(frozen=True)
class Training:
    lora: Adapter = field(default_factory=Adapter)
    reward_weights: Weights = field(default_factory=Weights)
    group_size: int = 4
    clip_eps: float = 0.2
    kl_beta: float = 0.04
    max_tool_calls: int = 4


@dataclass(frozen=True)
class Api:
    generator_provider: str = "local"
    verifier_provider: str = ""
    rpm_limit: int = 5
    rpd_limit: int = 20
    safety_margin: float = 0.95
    max_retries: int = 3
    retry_delay: float = 5.0


@dataclass(frozen=True)
class Evaluation:
    judge_sample_n: int = 10
    bootstrap_n: int = 2000
    bootstrap_ci: float = 0.95
    ece_n_bins: int = 10
    max_calls: int = 50
    calls_per_finding: int = 6


@dataclass(frozen=True)
class Limits:
    cooldown_s: int = 5
    per_minute: int = 10
    per_day: int = 500


@dataclass(frozen=True)
class Config:
    seed: int = 42
    environment: str = "auto"
    data: Data = field(default_factory=Data)
    model: Model = field(default_factory=Model)
    training: Training = field(default_factory=Training)
    api: Api = field(default_factory=Api)
    evaluation: Evaluation = field(default_factory=Evaluation)
    limits: Limits = field(default_factory=Limits)


def merged(base: dict, over: dict) -> dict:
    """over laid on base, nested dictionaries key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def build(kind: type, values: dict) -> Any:
    """A dataclass from a dictionary; unknown keys are an error."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(values) - set(fields):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    default = kind()
    return kind(**{k: build(type(getattr(default, k)), v) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def read(path: str) -> dict:
    text = fetch(path).decode()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML package; JSON needs none") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def load(path: str | None = None, overlay: str | None = None) -> Config:
    values: dict = {}
    for p in (path, overlay):
        if p:
            values = merged(values, read(p))
    return build(Config, values)


def load_env(path: str = ".env") -> dict[str, str]:
    """KEY=value lines of a file into the environment; what is set already stays."""
    found = {}
    if Path(path).exists():
        for line in Path(path).read_text().splitlines():
            key, sign, value = line.strip().partition("=")
            if sign and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("'\"")
                os.environ.setdefault(key.strip(), found[key.strip()])
    return found
