"""The driver tables seen as demand data.

An event is a trip, its user the station; the customer's market segment is the frozen entity; the
event value is the station's inventory at that moment. The SQL fragments state the same views for
the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.operators.entities import entity_metadata, to_entities
from demandspark.operators.labels import hourly_counts
from demandspark.operators.panel import add_lags, complete_panel
from demandspark.params import Params

PARAMS = Params(timezone="UTC")
# Inventory readings of one user are hours apart, so the gap and staleness limits are widened.
PROXY_PARAMS = Params(max_gap_minutes=1440.0, max_staleness_minutes=60.0, sample_spacing_seconds=900.0, slice_minutes=1440)
NOW = "2024-01-29 12:30:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("station_short_name"), F.col("ts").alias("start_time"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_counts(trips(spark, sf_dir))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        F.concat(F.lit("id-"), key.cast("string")).alias("station_id"),
        key.cast("string").alias("short_name"),
        F.col("c_name").alias("name"),
        (F.lit(40.5) + (key * 7919 % 1000) / F.lit(2000.0)).alias("lat"),
        (F.lit(-74.2) + (key * 104729 % 1000) / F.lit(1600.0)).alias("lon"),
        (key % 40 + 10).cast("int").alias("capacity"),
        F.col("c_nationkey").cast("string").alias("region_id"),
        F.col("c_mktsegment").alias("entity_id"),
    )


def station_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("station_short_name"), F.col("c_mktsegment").alias("entity_id")
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_metadata(stations(spark, sf_dir))


def entity_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_entities(hourly(spark, sf_dir), station_entity(spark, sf_dir))


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times only: the cheap way to the first and last hour."""
    return load(spark, sf_dir, "events").select(F.col("ts").alias("hour_ts"))


def station_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select(
        F.col("station_short_name").alias("entity_id"), "hour_ts", F.col("departures").cast("double").alias("departures")
    )


def station_panel(spark: SparkSession, sf_dir: str, params: Params = PARAMS) -> DataFrame:
    return complete_panel(station_obs(spark, sf_dir), params, bounds=event_hours(spark, sf_dir))


def entity_panel(spark: SparkSession, sf_dir: str, params: Params = PARAMS) -> DataFrame:
    return complete_panel(entity_hours(spark, sf_dir), params, bounds=event_hours(spark, sf_dir))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather made from the number of events per hour."""
    per_hour = hourly(spark, sf_dir).groupBy("hour_ts").agg(F.sum("departures").alias("n"))
    return per_hour.select(
        "hour_ts",
        (F.col("n") * F.lit(0.5)).alias("temperature_c"),
        ((F.col("n") % 7) * F.lit(0.25)).alias("precipitation_mm"),
        (F.col("n") % 20).cast("double").alias("wind_speed_kmh"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("id-"), F.col("user_id").cast("string")).alias("station_id"),
        F.col("ts").alias("snapshot_ts"),
        F.floor("value").cast("int").alias("num_bikes_available"),
        F.when((F.col("event_type") == "error") & (k % 3 == 0), 0).otherwise(1).alias("is_renting"),
        F.when(k % 7 == 0, 0).otherwise(1).alias("is_installed"),
        F.timestamp_add("MINUTE", -k, F.col("ts")).alias("last_reported"),
    )


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations(spark, sf_dir).drop("entity_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two naive forecasts per entity and hour; the weekly one is the later, served one."""
    panel = add_lags(entity_panel(spark, sf_dir), PARAMS)
    versions = F.explode(
        F.array(
            F.struct(F.lit("v1").alias("model_version"), F.col("lag_24h").alias("predicted"), F.lit(120).alias("lead")),
            F.struct(F.lit("v2").alias("model_version"), F.col("lag_168h").alias("predicted"), F.lit(60).alias("lead")),
        )
    ).alias("v")
    return panel.select("entity_id", F.col("hour_ts").alias("target_hour_ts"), versions).select(
        "entity_id", "target_hour_ts", "v.predicted", "v.model_version",
        F.timestamp_add("MINUTE", -F.col("v.lead"), F.col("target_hour_ts")).alias("predicted_at"),
    ).where("predicted is not null")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round ratios for comparison; adding 0.0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# --- the same views as SQL common table expressions ---------------------------------------------

HOURLY = """hourly AS (
  SELECT CAST(user_id AS VARCHAR) AS station_short_name, date_trunc('hour', ts) AS hour_ts, count(*) AS departures
  FROM events GROUP BY 1, 2)"""
SMAP = """smap AS (
  SELECT CAST(c_custkey AS VARCHAR) AS station_short_name, c_mktsegment AS entity_id FROM customer)"""
STATIONS = """stations AS (
  SELECT 'id-' || CAST(c_custkey AS VARCHAR) AS station_id, CAST(c_custkey AS VARCHAR) AS short_name, c_name AS name,
         40.5 + (c_custkey * 7919 % 1000) / 2000.0 AS lat, -74.2 + (c_custkey * 104729 % 1000) / 1600.0 AS lon,
         CAST(c_custkey % 40 + 10 AS INTEGER) AS capacity, CAST(c_nationkey AS VARCHAR) AS region_id,
         c_mktsegment AS entity_id
  FROM customer)"""
ENTITIES = """entities AS (
  SELECT entity_id, avg(lat) AS lat, avg(lon) AS lon, CAST(sum(capacity) AS DOUBLE) AS capacity, count(*) AS n_stations
  FROM stations GROUP BY 1)"""
ENTITY_HOURS = """entity_hours AS (
  SELECT entity_id, hour_ts, CAST(sum(departures) AS DOUBLE) AS departures
  FROM hourly JOIN smap USING (station_short_name) GROUP BY 1, 2)"""
WEATHER = """weather AS (
  SELECT hour_ts, n * 0.5::DOUBLE AS temperature_c, (n % 7) * 0.25::DOUBLE AS precipitation_mm,
         CAST(n % 20 AS DOUBLE) AS wind_speed_kmh
  FROM (SELECT date_trunc('hour', ts) AS hour_ts, count(*) AS n FROM events GROUP BY 1))"""
SNAPSHOTS = """snapshots AS (
  SELECT 'id-' || CAST(user_id AS VARCHAR) AS station_id, ts AS snapshot_ts,
         CAST(floor(value) AS INTEGER) AS num_bikes_available,
         CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 0 ELSE 1 END AS is_renting,
         CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS is_installed,
         ts - to_minutes(k) AS last_reported
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def dense(source: str, name: str = "panel", key: str = "entity_id", extra: int = 0) -> str:
    """Grid, left join and islands: the panel built the long way."""
    hi = f"hi + INTERVAL {extra} HOUR" if extra else "hi"
    return f"""{name}_b AS (SELECT min(hour_ts) AS lo, max(hour_ts) AS hi FROM {source}),
{name}_g AS (
  SELECT e.entity_id, unnest(generate_series(lo, {hi}, INTERVAL 1 HOUR)) AS hour_ts
  FROM (SELECT DISTINCT {key} AS entity_id FROM {source}) e, {name}_b),
{name}_j AS (
  SELECT g.entity_id, g.hour_ts, CAST(o.departures AS DOUBLE) AS departures,
         (o.departures IS NULL AND g.hour_ts <= hi) AS missing, g.hour_ts > hi AS beyond
  FROM {name}_g g CROSS JOIN {name}_b LEFT JOIN {source} o ON o.{key} = g.entity_id AND o.hour_ts = g.hour_ts),
{name}_c AS (
  SELECT *, CASE WHEN missing IS DISTINCT FROM lag(missing) OVER (PARTITION BY entity_id ORDER BY hour_ts) THEN 1 ELSE 0 END AS chg
  FROM {name}_j),
{name}_r AS (SELECT *, sum(chg) OVER (PARTITION BY entity_id ORDER BY hour_ts) AS run FROM {name}_c),
{name}_l AS (SELECT *, count(*) OVER (PARTITION BY entity_id, run) AS len FROM {name}_r),
{name} AS (
  SELECT entity_id, hour_ts,
         CASE WHEN departures IS NOT NULL THEN departures WHEN missing AND len <= 24 THEN 0.0 END AS departures,
         CASE WHEN beyond THEN NULL WHEN missing THEN len ELSE 0 END AS missing_run_length
  FROM {name}_l)"""


def lags_sql(hours: tuple[int, ...] = PARAMS.lag_hours) -> str:
    return ", ".join(f"lag(departures, {h}) OVER (PARTITION BY entity_id ORDER BY hour_ts) AS lag_{h}h" for h in hours)


def rolling_sql(windows: tuple[int, ...] = PARAMS.rolling_windows_hours, digits: int = 4) -> str:
    out = []
    for w in windows:
        frame = f"OVER (PARTITION BY entity_id ORDER BY hour_ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        ok = f"count(departures) {frame} >= {max(2, w // 4)}"
        out.append(f"CASE WHEN {ok} THEN round(avg(departures) {frame}, {digits}) END AS roll_mean_{w}h")
        out.append(f"CASE WHEN {ok} THEN round(stddev_samp(departures) {frame}, {digits}) END AS roll_std_{w}h")
    return ", ".join(out)


PREDICTIONS = f"""lagged AS (SELECT *, {lags_sql()} FROM panel),
predictions AS (
  SELECT entity_id, hour_ts AS target_hour_ts, lag_24h AS predicted, 'v1' AS model_version, hour_ts - INTERVAL 120 MINUTE AS predicted_at
  FROM lagged WHERE lag_24h IS NOT NULL
  UNION ALL
  SELECT entity_id, hour_ts, lag_168h, 'v2', hour_ts - INTERVAL 60 MINUTE FROM lagged WHERE lag_168h IS NOT NULL),
served AS (
  SELECT * FROM predictions
  QUALIFY row_number() OVER (PARTITION BY entity_id, target_hour_ts ORDER BY predicted_at DESC) = 1),
matched AS (
  SELECT s.entity_id, s.target_hour_ts, s.predicted, s.model_version, o.departures AS actual
  FROM served s JOIN entity_hours o ON o.entity_id = s.entity_id AND o.hour_ts = s.target_hour_ts)"""


def metrics_sql(actual: str, predicted: str, digits: int = 6, prefix: str = "") -> str:
    """The error metrics as aggregates, written out independently."""
    e = f"({predicted} - {actual})"
    r = lambda x: f"round({x}, {digits})"
    return ", ".join(
        [
            f"{r(f'avg(abs{e})')} AS {prefix}mae",
            f"{r(f'sqrt(avg({e} * {e}))')} AS {prefix}rmse",
            r(f"100 * avg(CASE WHEN abs({actual}) + abs({predicted}) = 0 THEN 0 ELSE 2 * abs{e} / (abs({actual}) + abs({predicted})) END)") + f" AS {prefix}smape",
            r(f"100 * avg(CASE WHEN {actual} > 0 THEN abs({e} / {actual}) END)") + f" AS {prefix}mape_nonzero",
            r(f"avg(CASE WHEN {actual} > 0 THEN 1.0 ELSE 0.0 END)") + f" AS {prefix}nonzero_share",
            r(f"CASE WHEN var_pop({actual}) > 0 THEN 1 - avg({e} * {e}) / var_pop({actual}) END") + f" AS {prefix}r2",
            f"{r(f'avg({actual})')} AS {prefix}mean_actual",
            "count(*) AS n",
        ]
    )


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
