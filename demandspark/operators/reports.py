"""Exploratory and operational reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.ordered import describe
from demandspark.functions.times import hours_before, utc_wall
from demandspark.operators.monitor import local_now, utc_now
from demandspark.params import PROXY_LABEL, Params


def station_profile(hourly: DataFrame) -> DataFrame:
    """Sum, mean and median per station. A station has one row per hour, so the median's state is
    bounded by the hours of the time range."""
    return hourly.groupBy("station_short_name").agg(
        F.sum("departures").cast("double").alias("total"),
        F.avg("departures").alias("mean"),
        F.median("departures").alias("median"),
    )


def profile_summary(profile: DataFrame, n_buckets: int = 256) -> DataFrame:
    """Distribution of the per-station figures."""
    return describe(profile, ["total", "mean", "median"], n_buckets)


def zero_share(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg((F.col("departures") == 0).cast("double")).alias("zero_share"),
        F.avg("departures").alias("mean_departures"),
        F.count("*").alias("n_rows"),
    )


def hour_profile(df: DataFrame) -> DataFrame:
    """Mean demand by hour of day, weekdays and weekends apart."""
    return df.groupBy(
        (F.weekday("hour_ts") >= 5).cast("int").alias("is_weekend"), F.hour("hour_ts").alias("hour")
    ).agg(F.avg("departures").alias("mean_departures"), F.count("*").alias("n_rows"))


def weekday_profile(df: DataFrame) -> DataFrame:
    return df.groupBy(F.weekday("hour_ts").alias("day_of_week")).agg(
        F.avg("departures").alias("mean_departures"), F.count("*").alias("n_rows")
    )


def city_demand(df: DataFrame, weather: DataFrame) -> DataFrame:
    """System-wide demand per hour with that hour's weather; hours lacking either are left out."""
    city = df.groupBy("hour_ts").agg(F.sum("departures").cast("double").alias("departures"))
    return city.join(weather, "hour_ts").dropna(subset=["departures", "temperature_c", "precipitation_mm"])


def weather_effect(city: DataFrame, dry_below: float = 0.1, wet_from: float = 1.0) -> DataFrame:
    """One row: correlation of demand with weather, and mean demand in dry and wet hours."""
    rain = F.col("precipitation_mm")
    return city.agg(
        F.corr("departures", "temperature_c").alias("corr_temperature"),
        F.corr("departures", "precipitation_mm").alias("corr_precipitation"),
        F.avg(F.when(rain < dry_below, F.col("departures"))).alias("dry_mean"),
        F.avg(F.when(rain >= wet_from, F.col("departures"))).alias("wet_mean"),
    ).withColumn("wet_change", F.try_divide("wet_mean", "dry_mean") - 1)


def key_overlap(hourly: DataFrame, info: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(key, matched, total)``: how many trip stations each candidate join key finds."""
    trip_ids = hourly.select(F.col("station_short_name").alias("k")).where("k is not null").distinct()
    total = trip_ids.agg(F.count("*")).scalar()
    candidates = info.select(*[F.col(k).cast("string").alias(k) for k in keys]).unpivot([], list(keys), "key", "k")
    hits = candidates.where("k is not null").distinct().join(trip_ids, "k", "left_semi").groupBy("key").agg(
        F.count("*").alias("matched")
    )
    names = info.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return names.join(hits, "key", "left").select("key", F.coalesce("matched", F.lit(0)).alias("matched"), total.alias("total"))


def newest_rows(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(name, latest, n_rows)`` per table."""
    parts = [
        df.agg(F.lit(name).alias("name"), F.max(F.col(ts).cast("timestamp_ntz")).alias("latest"), F.count("*").alias("n_rows"))
        for name, (df, ts) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ingest_summary(snaps: DataFrame, hourly: DataFrame, now: datetime | str | None, params: Params) -> DataFrame:
    """One row: distinct snapshots in the last hour, proxy hours in the last day, newest proxy hour."""
    seen = utc_wall(snaps, "snapshot_ts")
    recent = snaps.where(seen > hours_before(utc_now(now), 1)).agg(F.count_distinct("snapshot_ts"))
    proxy = hourly.where(F.col("label_source") == PROXY_LABEL)
    last_day = F.when(F.col("hour_ts") > hours_before(local_now(now, params), 24), F.col("hour_ts"))
    return proxy.agg(
        F.count_distinct(last_day).alias("proxy_hours_24h"), F.max("hour_ts").alias("latest_proxy_hour")
    ).withColumn("snapshots_1h", recent.scalar())


def relative_error_summary(by_entity: DataFrame, n_buckets: int = 256) -> DataFrame:
    return describe(by_entity, ["relative_error"], n_buckets)

