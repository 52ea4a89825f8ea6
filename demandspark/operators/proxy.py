"""Demand proxy from inventory snapshots.

Snapshots show how many bikes are docked, not how many rides were taken. The drop between two
consecutive snapshots of a station is a noisy lower estimate of departures; pairs that cannot be
trusted are rejected and counted by reason.

One station may own a large share of all snapshots, so no window runs over a whole station:
rows are split by (station, time slice), and the last row of the preceding slice is carried in.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.functions.coerce import clip0
from demandspark.functions.times import floor_hour, local_hour, micros, minutes_between, utc_wall
from demandspark.params import Params

CARRIED = ["snapshot_ts", "num_bikes_available", "is_renting", "is_installed", "last_reported"]


def clean_snapshots(snaps: DataFrame) -> DataFrame:
    """Typed snapshot rows; rows without station, time or count are dropped."""
    columns = []
    for name, kind in snaps.dtypes:
        if name in ("snapshot_ts", "last_reported") and kind == "string":
            columns.append(F.col(name).try_cast("timestamp").alias(name))
        elif name == "num_bikes_available":
            value = F.col(name).try_cast("double")
            columns.append(F.when(~F.isnan(value), value).alias(name))
        else:
            columns.append(F.col(name))
    return snaps.select(*columns).where("station_id is not null and snapshot_ts is not null and num_bikes_available is not null")


def _reject_reason(params: Params, columns: list[str]) -> Column:
    """First rule a pair fails, or NULL."""

    def both(flag: str) -> Column:
        return (F.coalesce(F.col(flag), F.lit(0)) == 1) & (F.coalesce(F.col("_prev")[flag], F.lit(0)) == 1)

    minutes = F.col("interval_minutes")
    reason = F.when(~((minutes > 0) & (minutes <= params.max_gap_minutes)), "implausible_interval_length")
    if params.require_is_renting and "is_renting" in columns:
        reason = reason.when(~both("is_renting"), "station_not_renting")
    if params.require_is_installed and "is_installed" in columns:
        reason = reason.when(~both("is_installed"), "station_not_installed")
    if "last_reported" in columns:
        staleness = minutes_between("last_reported", "snapshot_ts")
        reason = reason.when(F.coalesce(staleness > params.max_staleness_minutes, F.lit(False)), "stale_last_reported")
    return reason


def interval_pairs(snaps: DataFrame, params: Params) -> DataFrame:
    """Every consecutive snapshot pair of a station, with its reject reason (NULL = usable).

    Duplicated times are ordered by count and yield a zero-length, hence rejected, pair.
    """
    snaps = clean_snapshots(snaps)
    carried = [c for c in CARRIED if c in snaps.columns]
    width = params.slice_minutes * 60_000_000
    slice_no = F.floor(micros(utc_wall(snaps, "snapshot_ts")) / F.lit(width))
    # The row travels as one struct, so that both windows below need the same columns and share one shuffle.
    sliced = snaps.select(
        "station_id", slice_no.alias("_slice"), F.col("snapshot_ts").alias("_ts"),
        F.col("num_bikes_available").alias("_bikes"), F.struct(*carried).alias("_now"),
    )
    inside = Window.partitionBy("station_id", "_slice").orderBy("_ts", "_bikes")
    linked = sliced.withColumns(
        {"_before": F.lag("_now").over(inside), "_is_last": F.lead(F.lit(True)).over(inside).isNull()}
    )
    # The last row of every slice, passed on to the station's next slice. A station has at most as many of
    # them as the time range has slices.
    slices = Window.partitionBy("station_id").orderBy("_slice")
    carry = linked.where("_is_last").select("station_id", "_slice", F.lag("_now").over(slices).alias("_carry"))
    joined = linked.drop("_is_last").join(carry, ["station_id", "_slice"], "left")
    pairs = joined.select("station_id", "_now.*", F.coalesce("_before", "_carry").alias("_prev")).where("_prev is not null")
    return judge_pairs(pairs, params, carried)


def judge_pairs(pairs: DataFrame, params: Params, columns: list[str]) -> DataFrame:
    """Difference and verdict for rows carrying their predecessor in ``_prev``."""
    drop = F.col("_prev")["num_bikes_available"] - F.col("num_bikes_available")
    pairs = pairs.withColumn("interval_minutes", minutes_between(F.col("_prev")["snapshot_ts"], F.col("snapshot_ts")))
    return pairs.select(
        "station_id",
        F.col("snapshot_ts").alias("interval_end"),
        clip0(drop, params.max_drop_per_interval).alias("proxy_departures"),
        "interval_minutes",
        (drop > params.max_drop_per_interval).alias("capped"),
        _reject_reason(params, columns).alias("reject_reason"),
    )


def interval_departures(snaps: DataFrame, params: Params) -> DataFrame:
    """Usable pairs: ``(station_id, interval_end, proxy_departures, interval_minutes)``."""
    usable = interval_pairs(snaps, params).where("reject_reason is null")
    return usable.select("station_id", "interval_end", "proxy_departures", "interval_minutes")


def reject_counts(pairs: DataFrame) -> DataFrame:
    """``(reject_reason, n)``; usable pairs are listed as ``usable`` or ``capped_implausible_drop``."""
    label = F.coalesce("reject_reason", F.when(F.col("capped"), "capped_implausible_drop").otherwise("usable"))
    return pairs.groupBy(label.alias("reject_reason")).agg(F.count("*").alias("n"))


def hourly_totals(intervals: DataFrame, params: Params) -> DataFrame:
    """Sum and count per station and local hour, before any filter."""
    hour = local_hour(utc_wall(intervals, "interval_end"), params.timezone)
    return intervals.groupBy("station_id", hour.alias("hour_ts")).agg(
        F.sum("proxy_departures").alias("departures"), F.count("*").alias("n_intervals")
    )


def covered(hourly: DataFrame, params: Params) -> DataFrame:
    """Station-hours with enough intervals to stand for a whole hour."""
    expected = max(1.0, 3600.0 / params.sample_spacing_seconds)
    return hourly.where(F.col("n_intervals") / F.lit(expected) >= params.min_coverage)


def to_short_names(hourly: DataFrame, info: DataFrame) -> DataFrame:
    """Replace ``station_id`` by the short name shared with trip records; unmatched stations are dropped."""
    names = info.dropna(subset=["short_name"]).select("station_id", F.col("short_name").alias("station_short_name"))
    return hourly.join(names, "station_id").select("station_short_name", "hour_ts", "departures", "n_intervals")


def hourly_proxy(intervals: DataFrame, info: DataFrame, params: Params) -> DataFrame:
    """``(station_short_name, hour_ts, departures, n_intervals)`` for well covered local hours."""
    return to_short_names(covered(hourly_totals(intervals, params), params), info)


def drop_open_hour(hourly: DataFrame, newest_hour: Column) -> DataFrame:
    """Withhold the hour that is still filling; ``newest_hour`` comes from raw snapshot times."""
    return hourly.where(F.col("hour_ts") < newest_hour)


def newest_snapshot_hour(snaps: DataFrame, params: Params) -> Column:
    """Local hour of the newest snapshot, as a scalar subquery."""
    return snaps.agg(local_hour(F.max(utc_wall(snaps, "snapshot_ts")), params.timezone)).scalar()


def rederive(snaps: DataFrame, info: DataFrame, now: datetime, params: Params) -> DataFrame:
    """Proxy hours of the trailing lookback, complete hours only.

    The window starts on a full hour and also reads the snapshots just before it, so the first
    hour is as complete as when it was first derived and an upsert never shrinks it.
    """
    start = floor_hour(F.timestamp_add("HOUR", F.lit(-params.derive_lookback_hours), F.lit(str(now)).cast("timestamp_ntz")))
    lead_in = F.timestamp_add("SECOND", F.lit(-int(params.max_gap_minutes * 60)), start)
    recent = snaps.where(utc_wall(snaps, "snapshot_ts") >= lead_in)
    intervals = interval_departures(recent, params)
    intervals = intervals.where(utc_wall(intervals, "interval_end") >= start)
    return drop_open_hour(hourly_proxy(intervals, info, params), newest_snapshot_hour(recent, params))


def proxy_quality(intervals: DataFrame) -> DataFrame:
    """One row: ``(n_intervals, zero_share, mean_proxy_departures, p99_proxy_departures, n_stations)``."""
    n, v = F.col("n"), F.col("proxy_departures")
    # Bike counts are whole and capped, so there are at most cap + 1 values per station, and in all.
    counted = intervals.groupBy("station_id", "proxy_departures").agg(F.count("*").alias("n"))
    return counted.agg(
        F.sum(n).alias("n_intervals"),
        F.try_divide(F.sum(F.when(v == 0, n).otherwise(0)), F.sum(n)).alias("zero_share"),
        F.try_divide(F.sum(v * n), F.sum(n)).alias("mean_proxy_departures"),
        F.percentile(v, 0.99, n).alias("p99_proxy_departures"),
        F.count_distinct("station_id").alias("n_stations"),
    )
