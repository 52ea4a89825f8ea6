"""Declared table and document schemas."""

from __future__ import annotations

# Column order and types of the stored tables.
TABLES = {
    "station_info": (
        "station_id string, short_name string, name string, lat double, lon double, "
        "capacity int, region_id string, updated_at timestamp"
    ),
    "status_snapshots": (
        "station_id string, snapshot_ts timestamp, num_bikes_available int, num_ebikes_available int, "
        "num_bikes_disabled int, num_docks_available int, num_docks_disabled int, "
        "is_installed smallint, is_renting smallint, is_returning smallint, last_reported timestamp"
    ),
    "hourly_departures": (
        "station_short_name string, hour_ts timestamp_ntz, departures double, label_source string, "
        "n_intervals int, updated_at timestamp"
    ),
    "predictions": (
        "entity_id string, target_hour_ts timestamp_ntz, predicted double, model_name string, "
        "model_version string, predicted_at timestamp"
    ),
    "features": "entity_id string, hour_ts timestamp_ntz, payload string, created_at timestamp",
    "model_metrics": (
        "computed_at timestamp, window_start timestamp_ntz, window_end timestamp_ntz, model_name string, "
        "model_version string, n_samples bigint, rolling_mae double, rolling_rmse double, "
        "drift_share double, dataset_drift boolean, breached boolean, breach_reason string"
    ),
    "weather": "hour_ts timestamp_ntz, temperature_c double, precipitation_mm double, wind_speed_kmh double",
    "model_registry": (
        "version int, model_name string, path string, kind string, reason string, metric string, "
        "score_as_served double, score_in_process double, label_provenance string, stage string, "
        "train_start timestamp_ntz, train_end timestamp_ntz, granularity string, mapping_path string, seed bigint, "
        "recorded_at timestamp"
    ),
}

# Primary keys, where the table has one.
KEYS = {
    "station_info": ["station_id"],
    "status_snapshots": ["station_id", "snapshot_ts"],
    "hourly_departures": ["station_short_name", "hour_ts", "label_source"],
    "features": ["entity_id", "hour_ts"],
    "weather": ["hour_ts"],
}

# Feed documents. Scalars are read as text so that odd encodings (quoted numbers,
# numeric booleans) reach the tolerant casts instead of spoiling the record.
INFO_FEED = (
    "last_updated string, data struct<stations: array<struct<station_id: string, short_name: string, "
    "name: string, lat: string, lon: string, capacity: string, region_id: string>>>"
)
STATUS_FEED = (
    "last_updated string, data struct<stations: array<struct<station_id: string, "
    "num_bikes_available: string, num_ebikes_available: string, num_bikes_disabled: string, "
    "num_docks_available: string, num_docks_disabled: string, is_installed: string, "
    "is_renting: string, is_returning: string, last_reported: string>>>"
)
WEATHER_ARCHIVE = (
    "hourly struct<time: array<string>, temperature_2m: array<string>, "
    "precipitation: array<string>, wind_speed_10m: array<string>>"
)
WEATHER_FORECAST = (
    "properties struct<periods: array<struct<startTime: string, temperature: string, "
    "temperatureUnit: string, windSpeed: string, "
    "probabilityOfPrecipitation: struct<value: string>>>>"
)
