"""Hourly weather from archive and forecast documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.coerce import to_celsius, to_double, wind_kmh
from demandspark.operators.keys import first_per_key

COLUMNS = ["hour_ts", "temperature_c", "precipitation_mm", "wind_speed_kmh"]


def parse_weather_archive(docs: DataFrame) -> DataFrame:
    """Parallel hourly arrays to rows; unreadable numbers become NULL. Documents without hours give no rows."""
    zipped = F.arrays_zip(
        F.col("hourly.time").alias("time"),
        F.col("hourly.temperature_2m").alias("temperature_2m"),
        F.col("hourly.precipitation").alias("precipitation"),
        F.col("hourly.wind_speed_10m").alias("wind_speed_10m"),
    )
    rows = docs.select(F.explode(zipped).alias("r"))
    return rows.select(
        F.col("r.time").try_cast("timestamp_ntz").alias("hour_ts"),
        to_double(F.col("r.temperature_2m")).alias("temperature_c"),
        to_double(F.col("r.precipitation")).alias("precipitation_mm"),
        to_double(F.col("r.wind_speed_10m")).alias("wind_speed_kmh"),
    )


def parse_weather_forecast(docs: DataFrame) -> DataFrame:
    """Forecast periods to rows: wall-clock start, Celsius, km/h, and rain probability as pseudo-millimetres.

    Periods whose start cannot be read are skipped.
    """
    rows = docs.select(F.explode("properties.periods").alias("p")).select("p.*")
    start = F.substring("startTime", 1, 19).try_cast("timestamp_ntz")
    chance = to_double(F.col("probabilityOfPrecipitation.value"))
    wind = F.coalesce(to_double(F.col("windSpeed")), wind_kmh(F.col("windSpeed")))
    return rows.select(
        start.alias("hour_ts"),
        to_celsius(to_double(F.col("temperature")), F.col("temperatureUnit")).alias("temperature_c"),
        F.coalesce(chance / 100.0, F.lit(0.0)).alias("precipitation_mm"),
        wind.alias("wind_speed_kmh"),
    ).where("hour_ts is not null")


def combine_weather(frames: Sequence[DataFrame], last_wins: bool = False) -> DataFrame:
    """One row per hour from several sources; the earliest frame wins, or the latest."""
    sign = -1 if last_wins else 1
    ranked = [f.select(*COLUMNS).withColumn("_rank", F.lit(sign * i)) for i, f in enumerate(frames)]
    union = reduce(DataFrame.unionByName, ranked)
    return first_per_key(union, ["hour_ts"], ["_rank", *COLUMNS[1:]]).drop("_rank")


def live_weather(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary forecast, or the fallback where the primary delivered nothing at all."""
    found = primary.agg(F.count("*")).scalar()
    return primary.select(*COLUMNS).unionByName(fallback.select(*COLUMNS).where(found == 0))


def weather_for(series: DataFrame, weather: DataFrame, ts: str = "hour_ts") -> DataFrame:
    """Weather from the day before the first to the day after the last hour of a series, ordered."""
    lo = series.agg(F.date_sub(F.to_date(F.min(ts)), 1).cast("timestamp_ntz")).scalar()
    hi = series.agg(F.date_add(F.to_date(F.max(ts)), 2).cast("timestamp_ntz")).scalar()
    window = weather.where((F.col("hour_ts") >= lo) & (F.col("hour_ts") < hi))
    return combine_weather([window]).orderBy("hour_ts")
