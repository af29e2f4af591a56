"""Filters and scoring constants."""

from __future__ import annotations

from dataclasses import dataclass

from footmark.functions.dates import Span


@dataclass(frozen=True)
class Filters:
    """Literals that narrow a question; ``None`` leaves that dimension open."""

    span: Span
    metro: str | None = None
    category: str | None = None
    co_tag: str | None = None
    radius_km: float = 1.0

    def __post_init__(self) -> None:
        if not (0 <= self.radius_km < float("inf")):
            raise ValueError("A radius is a finite number of kilometres from 0 up")


# Metric keys in their canonical order, and their labels.
METRIC_KEYS = (
    "demand_rate", "competition", "quality_gap", "momentum", "stability", "weather_resilience",
)
METRIC_LABELS = {
    "demand_rate": "Demand",
    "competition": "Competition",
    "quality_gap": "Quality gap",
    "momentum": "Momentum",
    "stability": "Stability",
    "weather_resilience": "Weather resilience",
}

# Weight presets in metric order.
PRESETS = {
    "Balanced": (0.35, 0.20, 0.10, 0.15, 0.05, 0.15),
    "Demand-focused": (0.55, 0.10, 0.05, 0.15, 0.05, 0.10),
    "Low-competition": (0.25, 0.40, 0.10, 0.10, 0.05, 0.10),
    "Weather-resilient": (0.25, 0.10, 0.05, 0.10, 0.10, 0.40),
}


@dataclass(frozen=True)
class ScoringConfig:
    """Fixed values of area scoring."""

    shrinkage_k: float = 3.0
    min_observed_businesses: int = 3
    min_radius_km: float = 1.0
    momentum_window_months: int = 12
    min_months_momentum: int = 24
    min_months_stability: int = 12
    wet_day_mm: float = 2.5
    hot_day_c: float = 32.0
    min_stratum_days: int = 3
    min_weather_days: int = 20
    high_min_businesses: int = 5
    high_min_checkins: int = 500
    high_min_days: int = 365
    low_max_businesses: int = 2
    low_checkins: int = 100
    n_bootstrap: int = 200
    interval_low: float = 0.05
    interval_high: float = 0.95
    n_top_factors: int = 3
    min_scored_areas: int = 5
    short_coverage_days: int = 365
    min_estimator_train_areas: int = 8
    ridge_alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)


@dataclass(frozen=True)
class ForecastConfig:
    """Fixed values of the calendar fit; the support threshold is a parameter of the data."""

    min_training_checkins: int = 20
    prior_business_days: int = 30
