"""Reads from the stored tables. Every filter is a plain predicate on a stored column, so it reaches the scan."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.times import minutes_between
from demandspark.operators.labels import HOURLY, resolve_labels
from demandspark.operators.monitor import local_now
from demandspark.params import Params
from demandspark.session import materialise
from demandspark.schemas import TABLES


def table(
    spark: SparkSession, path: str, name: str, columns: Sequence[str] | None = None, ts_col: str | None = None,
    start: datetime | str | None = None, end: datetime | str | None = None, day: bool = False,
) -> DataFrame:
    """A stored table with its declared schema, optionally projected and cut to ``[start, end)``.

    ``day`` says that it is partitioned by the calendar day of ``ts_col``: the range then prunes partitions.
    """
    df = spark.read.schema(f"{TABLES[name]}, day date" if day else TABLES[name]).parquet(path)
    if day and start is not None:
        df = df.where(F.col("day") >= F.lit(str(start)).cast("timestamp_ntz").cast("date"))
    if day and end is not None:
        df = df.where(F.col("day") <= F.lit(str(end)).cast("timestamp_ntz").cast("date"))
    df = half_open(df, ts_col, start, end) if ts_col else df
    return df.select(*columns) if columns else df


def half_open(df: DataFrame, ts_col: str, start=None, end=None) -> DataFrame:
    kind = df.schema[ts_col].dataType
    if start is not None:
        df = df.where(F.col(ts_col) >= F.lit(str(start)).cast(kind))
    if end is not None:
        df = df.where(F.col(ts_col) < F.lit(str(end)).cast(kind))
    return df


def newest(df: DataFrame, n: int, ts_col: str = "computed_at") -> DataFrame:
    """The n newest rows; a top-k, not a full sort."""
    return df.orderBy(F.col(ts_col).desc(), *[c for c in df.columns if c != ts_col]).limit(n)


def recent_snapshots(snaps: DataFrame, since: datetime | str) -> DataFrame:
    return half_open(snaps, "snapshot_ts", since).orderBy("station_id", "snapshot_ts")


def sum_hourly(hourly: DataFrame) -> DataFrame:
    """One row per station and hour. Where several labels are stored, one is chosen, not summed."""
    if "label_source" in hourly.columns:
        hourly = resolve_labels(hourly.select(*HOURLY, "label_source"))
    # Dealt anew into all shuffle partitions: else the sums share their task, and its memory, with the counts they are
    # taken of, in the few partitions that adaptive execution makes of well compressed rows. The other order of the keys
    # keeps Spark from taking the rows as dealt already.
    parts = int(hourly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hourly = hourly.repartition(parts, "hour_ts", "station_short_name")
    return hourly.groupBy("station_short_name", "hour_ts").agg(F.sum("departures").cast("double").alias("departures"))


def latest_window(hourly: DataFrame, hours: int) -> DataFrame:
    """Rows of the last hours before the newest one; the bound is a scalar subquery on one column."""
    bound = hourly.agg(F.timestamp_add("HOUR", F.lit(-hours), F.max("hour_ts"))).scalar()
    return sum_hourly(hourly.where(F.col("hour_ts") >= bound))


def window_since(hourly: DataFrame, cutoff: datetime | str, label_source: str | None = None) -> DataFrame:
    df = half_open(hourly, "hour_ts", cutoff)
    if label_source is not None:
        df = df.where(F.col("label_source") == label_source)
    return sum_hourly(df)


def recent_history(
    primary: DataFrame, fallback: DataFrame | None, now: datetime | str | None, params: Params, hours: int | None = None
) -> DataFrame:
    """The latest window with ``source`` (fresh, stale or fallback) and ``latest_hour``.

    The fallback is read only when the primary table is empty; an empty result means ``none``.
    """
    hours = hours or params.history_hours

    def window(df: DataFrame) -> DataFrame:
        return latest_window(df, hours).withColumn("latest_hour", df.agg(F.max("hour_ts")).scalar())

    age = minutes_between(F.col("latest_hour"), local_now(now, params)) / 60.0
    label = F.when(age <= params.history_freshness_hours, "fresh").otherwise("stale")
    if fallback is not None and primary.isEmpty():
        return window(fallback).withColumn("source", F.lit("fallback"))
    return window(primary).withColumn("source", label)


def history_source(history: DataFrame) -> DataFrame:
    """One row ``(source, latest_hour, age_known)`` from :func:`recent_history`."""
    return history.agg(F.coalesce(F.max("source"), F.lit("none")).alias("source"), F.max("latest_hour").alias("latest_hour"))


def unpack_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """JSON payload back to columns; names the payload lacks come out NULL."""
    schema = ", ".join(f"`{n}` double" for n in names)
    parsed = F.from_json("payload", schema)
    return df.select("entity_id", "hour_ts", parsed.alias("p")).select("entity_id", "hour_ts", *[F.col("p")[n].alias(n) for n in names])


def payload_entries(df: DataFrame) -> DataFrame:
    """Payload as ``(entity_id, hour_ts, name, value)`` when the names are not known beforehand."""
    entries = F.explode(F.from_json("payload", "map<string,double>")).alias("name", "value")
    return df.select("entity_id", "hour_ts", entries)


def load_hourly(monthly: DataFrame, months: Sequence[str], live: DataFrame | None, params: Params) -> DataFrame:
    """Hourly counts of some months: pruned read, regroup, live stations only, busy stations only.

    ``monthly`` is the monthly table with a ``month`` column (``yyyyMM``). A month that it lacks is warned of and left
    out, as training can do without it; a ``ValueError`` is raised when none of them is there.
    """
    from demandspark.operators.keys import restrict
    from demandspark.operators.labels import merge_hourly, min_volume

    part = monthly.where(F.col("month").isin(*months))
    # Partition values, at most one row per wanted month.
    present = {r.month for r in part.select("month").distinct().collect()}
    if missing := sorted(set(months) - present):
        if not present:
            raise ValueError(f"none of the months {missing} could be loaded")
        warnings.warn(f"months {missing} are not in the table and are left out", stacklevel=2)
    hourly = merge_hourly([part])
    if live is not None:
        hourly = restrict(hourly, live.select(F.col("short_name").alias("station_short_name")), "station_short_name")
    return min_volume(hourly, params.min_departures_per_station)


PART = "station_short_name string, hour_ts timestamp_ntz, departures bigint, part string, month string"


def store_parts(counts: DataFrame, path: str) -> None:
    """Store partial hourly counts by the ``file`` they come from; a file that is loaded again replaces its own part.

    Sums over all parts are the hourly counts, so a corrected or late file needs no other file to be read. All months of
    its former part go, also those that it no longer touches. Each part's old rows are removed before the new ones are
    written, so that a load that was interrupted is put right by running it again.
    """
    from demandspark.sinks.tables import drop_partitions

    spark = counts.sparkSession
    tagged = materialise(
        counts.select(
            "station_short_name", "hour_ts", F.col("departures").cast("bigint").alias("departures"),
            F.md5("file").alias("part"), F.date_format("hour_ts", "yyyyMM").alias("month"),
        ), "parts",
    )
    drop_partitions(spark, path, "part", tagged.select("part"))
    tagged.repartition("part", "month").write.mode("append").partitionBy("part", "month").parquet(path)


def drop_part(spark: SparkSession, path: str, file: str) -> None:
    """Remove what a file contributed."""
    from demandspark.sinks.tables import drop_partitions

    drop_partitions(spark, path, "part", spark.range(1).select(F.md5(F.lit(file)).alias("part")))


def stored_parts(spark: SparkSession, path: str) -> DataFrame:
    """The partial counts of all files, with ``month``: what :func:`load_hourly` sums."""
    return spark.read.schema(PART).parquet(path)


def cache_month(hourly: DataFrame, path: str) -> None:
    """Store hourly counts by month; only the months present in the input are replaced."""
    from demandspark.sinks.tables import write_table

    tagged = hourly.withColumn("month", F.date_format("hour_ts", "yyyyMM"))
    write_table(tagged, path, ["month"], ["station_short_name", "hour_ts"])


def cached_month(spark: SparkSession, path: str) -> DataFrame:
    """The monthly table; the month stays text."""
    schema = "station_short_name string, hour_ts timestamp_ntz, departures bigint, month string"
    return spark.read.schema(schema).parquet(path)
