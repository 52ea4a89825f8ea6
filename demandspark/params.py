"""Parameters shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The ordered feature names of the model contract.
CALENDAR_FEATURES = (
    "hour", "day_of_week", "is_weekend", "is_holiday", "month", "season",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
)
SEASONAL_GROUPS = {
    "annual_cycle": ("day_of_year_sin", "day_of_year_cos", "week_of_year"),
    "daylight": ("daylight_hours", "is_daylight", "hours_from_solar_noon"),
}
ENTITY_FEATURES = ("capacity", "n_stations", "lat", "lon")
WEATHER_FEATURES = ("temperature_c", "precipitation_mm", "wind_speed_kmh")

# Label provenance tags.
TRUE_LABEL = "trip_csv"
PROXY_LABEL = "gbfs_proxy"


@dataclass(frozen=True)
class Params:
    timezone: str = "America/New_York"
    seed: int = 42
    latitude: float = 40.7306
    longitude: float = -73.9866

    granularity: str = "cluster"
    n_clusters: int = 40
    min_departures_per_station: int = 50
    max_gap_fill_hours: int = 24
    lag_hours: tuple[int, ...] = (1, 2, 3, 24, 168)
    rolling_windows_hours: tuple[int, ...] = (24, 168, 720)
    seasonal_feature_groups: tuple[str, ...] = ()
    warmup_hours: int | None = 168
    holiday_country: str = "US"

    test_size_hours: int = 336
    validation_size_hours: int = 168
    retrain_window_days: int = 90
    sequence_length: int = 168

    promotion_metric: str = "mae"
    min_relative_improvement: float = 0.02

    max_forecast_horizon_hours: int = 24
    history_freshness_hours: int = 6
    history_buffer_hours: int = 24

    mae_window_hours: int = 24
    mae_threshold: float = 45.0
    mae_degradation_ratio: float = 1.5
    drift_share_threshold: float = 0.3
    psi_threshold: float = 0.25
    psi_bins: int = 10
    min_samples: int = 200
    retrain_cooldown_hours: float = 6.0
    snapshot_max_age_minutes: float = 30.0
    departures_max_age_minutes: float = 180.0
    drift_exclude_features: tuple[str, ...] = CALENDAR_FEATURES

    sample_spacing_seconds: float = 60.0
    min_coverage: float = 0.5
    derive_lookback_hours: int = 3
    snapshot_retention_days: float = 3.0
    snapshot_retention_hours: float | None = None

    require_is_renting: bool = True
    require_is_installed: bool = True
    max_drop_per_interval: float = 10.0
    max_gap_minutes: float = 3.0
    max_staleness_minutes: float = 30.0

    # Width of the time slices a station's snapshots are split into, so that one
    # busy station is spread over many tasks. Must not be shorter than max_gap_minutes.
    slice_minutes: int = 60
    late_snapshot_delay: str = "3 hours"

    # Number of value slices used for distributed ranks (quantiles, two-sample tests).
    rank_buckets: int = 256

    def but(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def warmup(self) -> int:
        return max(self.lag_hours) if self.warmup_hours is None else self.warmup_hours

    @property
    def history_hours(self) -> int:
        """Hours of history a single scoring row can reach back to, plus the buffer."""
        return max(self.lag_hours + self.rolling_windows_hours) + self.history_buffer_hours

    @property
    def lag_features(self) -> list[str]:
        return [f"lag_{h}h" for h in self.lag_hours]

    @property
    def rolling_features(self) -> list[str]:
        return [f"roll_{stat}_{w}h" for w in self.rolling_windows_hours for stat in ("mean", "std")]

    @property
    def seasonal_features(self) -> list[str]:
        unknown = set(self.seasonal_feature_groups) - set(SEASONAL_GROUPS)
        if unknown:
            import warnings

            warnings.warn(f"unknown seasonal feature groups ignored: {sorted(unknown)}", stacklevel=2)
        return [c for g in self.seasonal_feature_groups for c in SEASONAL_GROUPS.get(g, ())]

    @property
    def features(self) -> list[str]:
        """Ordered feature contract: training and scoring use this same list."""
        return [
            *CALENDAR_FEATURES, *self.seasonal_features, *self.lag_features,
            *self.rolling_features, *ENTITY_FEATURES, *WEATHER_FEATURES,
        ]
