"""Tunable constants of the operators, and the time that stands for now."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Params:
    as_of: datetime = datetime(2024, 1, 31)
    gate_threshold: int = 5
    min_length: int = 15
    route_factor: float = 1.25
    earth_km: float = 6371.0
    rate_km: float = 4.0
    rate_min: float = 250.0
    max_age_h: int = 6
    daily_budget: int = 2000
    min_confidence: int = 40
    quiet_from: int = 22
    quiet_to: int = 6
    alerts_per_hour: int = 15
    dedup_hours: int = 6
    remember_hours: int = 168
    reliable_sample: int = 30
    report_sample: int = 200
    bandit_trials: int = 15
    bandit_share: float = 0.3
    bandit_bonus: float = 0.5
    min_interval: int = 5
    min_interval_b: int = 15
    max_interval: int = 120
    posts_least: int = 2
    posts_unknown: int = 10
    posts_margin: int = 3
    posts_most_a: int = 50
    posts_most_b: int = 12
    window_factor: int = 2
    window_least: int = 30
    budget_slack: float = 0.7
    cost_per_post: float = 0.0026
    strikes: int = 3
    quarantine_min: int = 30
    quarantine_long_h: int = 24
    windows: tuple[int, ...] = field(default=(7, 30))


DEFAULT = Params()
