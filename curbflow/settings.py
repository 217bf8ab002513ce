"""Parameters that change results, as plain frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, fields

# The four ride-service families, in their published order.
SERVICES = ("yellow", "green", "fhv", "fhvhv")


@dataclass(frozen=True)
class QualityLimits:
    location_min: int = 1
    location_max: int = 265
    max_duration_minutes: float = 1440.0
    max_distance_miles: float = 500.0
    max_total_amount: float = 10000.0


@dataclass(frozen=True)
class SourceScope:
    """Which monthly files a complete lake must hold."""

    base_url: str = "https://data.example.org/trip-data"
    services: tuple[str, ...] = SERVICES
    historical_years: tuple[int, ...] = (2023, 2024, 2025)
    current_year: int = 2026


@dataclass(frozen=True)
class ModelSettings:
    """``zones_as_categories``: the classifier takes a zone as one categorical feature, so its vectors
    do not grow with the zones; otherwise, as published, as one feature a zone."""

    seed: int = 42
    horizon_days: int = 30
    forecast_test_days: int = 90
    forecast_trees: int = 80
    forecast_depth: int = 6
    clusters: int = 4
    cluster_iterations: int = 40
    classify_test_days: int = 90
    classify_trees: int = 100
    classify_depth: int = 10
    high_demand_quantile: float = 0.75
    zones_as_categories: bool = False

    def __post_init__(self) -> None:
        bad = [
            f.name
            for f in fields(self)
            if f.name not in ("seed", "high_demand_quantile", "zones_as_categories") and getattr(self, f.name) <= 0
        ]
        if bad:
            raise ValueError(f"model settings must be positive: {', '.join(bad)}")
        if not 0.0 < self.high_demand_quantile < 1.0:
            raise ValueError("high_demand_quantile must lie strictly between 0 and 1")


ANOMALY_THRESHOLD = 3.0
