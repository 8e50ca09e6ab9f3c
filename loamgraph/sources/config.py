"""The engine's settings, read from JSON and checked: unknown keys and values out of range are errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from loamgraph.operators.search import RANK_WEIGHTS


@dataclass(frozen=True)
class Limits:
    max_files: int = 50_000
    max_file_bytes: int = 2_000_000
    max_total_bytes: int = 200_000_000

    def __post_init__(self) -> None:
        for name, low, high in (("max_files", 1, 200_000), ("max_file_bytes", 100, 10_000_000), ("max_total_bytes", 1000, 2_000_000_000)):
            bounded(getattr(self, name), low, high, name)


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ()
    limits: Limits = field(default_factory=Limits)
    token_budget: int = 2000
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        bounded(self.token_budget, 128, 32_000, "token_budget")
        if not set(self.weights) <= set(RANK_WEIGHTS) or any(not 0 <= w <= 10 for w in self.weights.values()):
            raise ValueError("weights must be of known signals and between 0 and 10")


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return value


def load(text: str) -> Config:
    data = json.loads(text)
    unknown = set(data) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    limits = Limits(**data.pop("limits", {}))
    return Config(limits=limits, **{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})
