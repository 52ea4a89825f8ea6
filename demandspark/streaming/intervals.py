"""Interval differences and hourly totals on the stream, with native stateful aggregation.

A usable pair is at most ``max_gap_minutes`` apart. So a time slice of a station is complete on its
own once it also holds the previous slice's last ``max_gap_minutes`` as context: rows are copied to
the next slice when they are that close to its start. Each (station, slice) is one state entry that
is emitted and freed when the watermark passes; no station's history is ever held as a whole, rows
may arrive in any order within the allowed delay, and everything stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.times import local_hour, utc_wall
from demandspark.operators.proxy import covered, judge_pairs, to_short_names
from demandspark.params import Params

STATE = ["snapshot_ts", "num_bikes_available", "is_renting", "is_installed", "last_reported"]


def _slices(stream: DataFrame, params: Params) -> DataFrame:
    """Sorted snapshots per station and slice, own rows and context."""
    if params.max_gap_minutes > params.slice_minutes:
        raise ValueError("slice_minutes must not be shorter than max_gap_minutes")
    width = f"{params.slice_minutes} minutes"
    step = params.slice_minutes * 60
    seconds = F.unix_timestamp("snapshot_ts")
    next_start = F.timestamp_seconds((F.floor(seconds / step) + 1) * step)
    near_end = F.unix_micros(next_start) - F.unix_micros("snapshot_ts") <= int(params.max_gap_minutes * 60_000_000)
    copies = F.when(
        near_end,
        F.array(
            F.struct(F.col("snapshot_ts").alias("slot_ts"), F.lit(True).alias("own")),
            F.struct(next_start.alias("slot_ts"), F.lit(False).alias("own")),
        ),
    ).otherwise(F.array(F.struct(F.col("snapshot_ts").alias("slot_ts"), F.lit(True).alias("own"))))
    state = [c for c in STATE if c in stream.columns]
    known = stream.dropna(subset=["station_id", "snapshot_ts", "num_bikes_available"])
    placed = known.select("station_id", *state, F.explode(copies).alias("slot")).select("station_id", *state, "slot.*")
    # A set: replays of a snapshot collapse. Its size is bounded by the feed's cadence within one slice.
    return (
        placed.withWatermark("slot_ts", params.late_snapshot_delay)
        .groupBy(F.window("slot_ts", width).alias("slice"), "station_id")
        .agg(F.array_sort(F.collect_set(F.struct(*state, "own"))).alias("rows"))
    )


def _pairs(rows: Column) -> Column:
    size = F.size(rows)
    ahead, behind = F.slice(rows, F.lit(2), F.greatest(size - 1, F.lit(0))), F.slice(rows, F.lit(1), F.greatest(size - 1, F.lit(0)))
    linked = F.zip_with(behind, ahead, lambda p, c: F.struct(p.alias("p"), c.alias("c")))
    return F.filter(linked, lambda x: x["c"]["own"])


def stream_pairs(stream: DataFrame, params: Params) -> DataFrame:
    """Judged pairs no further apart than the slice allows, emitted once their slice is closed."""
    state = [c for c in STATE if c in stream.columns]
    exploded = _slices(stream, params).select("station_id", F.explode(_pairs(F.col("rows"))).alias("x"))
    rows = exploded.select("station_id", *[F.col("x.c")[c].alias(c) for c in state], F.col("x.p").alias("_prev"))
    return judge_pairs(rows, params, rows.columns)


def stream_intervals(stream: DataFrame, params: Params) -> DataFrame:
    """Streaming ``(station_id, interval_end, proxy_departures, interval_minutes)`` of usable pairs."""
    usable = stream_pairs(stream, params).where("reject_reason is null")
    return usable.select("station_id", "interval_end", "proxy_departures", "interval_minutes")


def hourly_of_batch(batch: DataFrame, params: Params) -> DataFrame:
    """Totals per station and UTC hour of one micro-batch of closed intervals.

    A closed slice arrives whole in one batch and slices consist of whole hours, so these totals are final.
    """
    if params.slice_minutes % 60:
        raise ValueError("hourly totals need slices of whole hours")
    utc = utc_wall(batch, "interval_end")
    return batch.groupBy(
        "station_id", F.date_trunc("hour", "interval_end").alias("hour_utc"), local_hour(utc, params.timezone).alias("hour_ts")
    ).agg(F.sum("proxy_departures").alias("departures"), F.count("*").alias("n_intervals"))


def hourly_writer(path: str, params: Params):
    """``foreachBatch`` function writing final hours; a replayed batch replaces its own partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        hours = hourly_of_batch(batch, params).withColumn("batch", F.lit(batch_id))
        hours.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def finish_hourly(hours: DataFrame, info: DataFrame, params: Params) -> DataFrame:
    """Stored hours to the hourly proxy: the repeated autumn hour is merged, thin hours are dropped."""
    merged = hours.groupBy("station_id", "hour_ts").agg(
        F.sum("departures").alias("departures"), F.sum("n_intervals").alias("n_intervals")
    )
    return to_short_names(covered(merged, params), info)
