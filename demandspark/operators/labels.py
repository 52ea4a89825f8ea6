"""Hourly labels: trip counts, unions of partial results, and which label wins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.times import floor_hour, parse_trip_time
from demandspark.operators.keys import first_per_key
from demandspark.params import PROXY_LABEL, TRUE_LABEL

HOURLY = ["station_short_name", "hour_ts", "departures"]
SOURCES = ("offline", "live", "blend")


def clean_trips(trips: DataFrame) -> DataFrame:
    """``(station_short_name, start_time)`` from raw text; unparseable times and blank stations are dropped."""
    parsed = trips.select(
        F.trim(F.col("station_raw")).alias("station_short_name"),
        parse_trip_time(F.col("start_time_raw")).alias("start_time"),
    )
    return parsed.where("start_time is not null and station_short_name <> ''")


def hourly_counts(trips: DataFrame) -> DataFrame:
    """Trips per station and hour; counting is partial before the shuffle, so a hot station costs one row per hour and task."""
    return trips.groupBy("station_short_name", floor_hour("start_time").alias("hour_ts")).agg(
        F.count("*").alias("departures")
    )


def hourly_parts(trips: DataFrame) -> DataFrame:
    """The same per source file: partial counts that add up to :func:`hourly_counts`, whatever files share an hour."""
    return trips.groupBy("file", "station_short_name", floor_hour("start_time").alias("hour_ts")).agg(F.count("*").alias("departures"))


def merge_hourly(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of partial hourly counts, summed again because parts may split an hour."""
    union = reduce(DataFrame.unionByName, [p.select(*HOURLY) for p in parts])
    return union.groupBy("station_short_name", "hour_ts").agg(F.sum("departures").alias("departures"))


def min_volume(hourly: DataFrame, n: float) -> DataFrame:
    """Rows of stations whose total reaches n."""
    busy = hourly.groupBy("station_short_name").agg(F.sum("departures").alias("_total")).where(F.col("_total") >= n)
    return hourly.join(busy.select("station_short_name"), "station_short_name", "left_semi")


def with_label(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("label_source", F.lit(source))


def resolve_labels(hourly: DataFrame) -> DataFrame:
    """One row per station and hour: a true count wins over a proxy, whatever else is stored."""
    rank = F.when(F.col("label_source") == TRUE_LABEL, 0).when(F.col("label_source") == PROXY_LABEL, 1).otherwise(2)
    return first_per_key(hourly, ["station_short_name", "hour_ts"], [rank, "label_source"])


def recent_labels(proxy: DataFrame, days: int) -> DataFrame:
    """The rows of the last ``days`` up to the newest hour; all of them where ``days`` is 0."""
    if days <= 0:
        return proxy
    first = proxy.agg(F.timestamp_add("DAY", F.lit(-days), F.max("hour_ts"))).scalar()
    return proxy.where(F.col("hour_ts") >= first)


def select_labels(true: DataFrame, proxy: DataFrame, source: str, window_days: int = 0) -> DataFrame:
    """Labels for training: ``offline`` (true), ``live`` (proxy) or ``blend`` (both, truth first).

    ``window_days`` limits the proxy to its last days; true labels are used in full.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown label source {source!r}; expected one of {SOURCES}")
    tagged_true = with_label(true.select(*HOURLY), TRUE_LABEL)
    if source == "offline":
        return tagged_true
    tagged_proxy = with_label(recent_labels(proxy.select(*HOURLY), window_days), PROXY_LABEL)
    if source == "live":
        return tagged_proxy
    return resolve_labels(tagged_true.unionByName(tagged_proxy))


def merge_station_info(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of station metadata; the earliest frame wins per short name."""
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return first_per_key(union, ["short_name"], ["_rank", "station_id"]).drop("_rank")


def bootstrap(hourly: DataFrame, months: int | None) -> DataFrame:
    """Hours of the last n months up to the newest one (all when n is None), tagged as true labels."""
    if months:
        first = hourly.agg(F.max("hour_ts") - F.make_ym_interval(F.lit(0), F.lit(months))).scalar()
        hourly = hourly.where(F.col("hour_ts") >= first)
    return with_label(hourly, TRUE_LABEL).withColumn("n_intervals", F.lit(None).cast("int"))
