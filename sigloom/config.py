"""Validated settings of a study."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from datetime import date


@dataclass(frozen=True, slots=True)
class StudyConfig:
    """Settings; the defaults are those of the published study."""

    universe: str = "sp100"
    start_date: str = "2015-01-01"
    end_date: str = "2026-07-01"
    forward_return_horizon: int = 5
    n_random_search_iters: int = 500
    n_bayesian_iters: int = 200
    random_seed: int = 42
    train_fraction: float = 0.60
    validation_fraction: float = 0.20
    test_fraction: float = 0.20
    transaction_cost_bps: float = 5.0

    def __post_init__(self) -> None:
        if not date.fromisoformat(self.start_date) < date.fromisoformat(self.end_date):
            raise ValueError("start_date must come before end_date")
        counts = ("forward_return_horizon", "n_random_search_iters", "n_bayesian_iters")
        if bad := [c for c in counts if getattr(self, c) < 1]:
            raise ValueError(f"must be at least 1: {', '.join(bad)}")
        shares = (self.train_fraction, self.validation_fraction, self.test_fraction)
        if min(shares) <= 0 or not math.isclose(sum(shares), 1.0, abs_tol=1e-9):
            raise ValueError("the three fractions must be positive and add up to 1")
        if self.transaction_cost_bps < 0:
            raise ValueError("transaction_cost_bps can't be negative")


def load_config(path: str) -> StudyConfig:
    """Read YAML; unknown or malformed content raises ``ValueError``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    known = {x.name for x in fields(StudyConfig)}
    if not isinstance(raw, dict) or not known - {"transaction_cost_bps"} <= set(raw) <= known:
        raise ValueError(f"{path} must map exactly these names: {', '.join(sorted(known))}")
    return StudyConfig(**raw)
