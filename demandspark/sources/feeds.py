"""Station feeds: nested JSON documents to typed rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.coerce import to_double, to_flag, to_int

TINY = 1e-6
COUNTS = ("num_ebikes_available", "num_bikes_disabled", "num_docks_available", "num_docks_disabled")
FLAGS = ("is_installed", "is_renting", "is_returning")


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _stations(feed: DataFrame) -> DataFrame:
    """One row per station entry; a document without a station list is an error, an empty list is not."""
    listed = F.when(
        F.col("data.stations").isNull(), F.raise_error(F.lit("feed document has no data.stations list"))
    ).otherwise(F.col("data.stations"))
    return feed.select("last_updated", F.explode(listed).alias("s")).select("last_updated", "s.*")


def _has_id() -> Column:
    return F.coalesce(F.col("station_id") != "", F.lit(False))


def _epoch(text: Column) -> Column:
    """Epoch seconds to an instant; missing, unreadable and 0 become NULL."""
    seconds = text.try_cast("double").try_cast("bigint")
    return F.when(seconds != 0, F.timestamp_seconds(seconds))


def _keep(rows: DataFrame, valid: Column, tally: Observation | None) -> DataFrame:
    if tally is not None:
        rows = rows.observe(tally, F.count_if(valid).alias("ok"), F.count_if(~valid).alias("rejected"))
    return rows.where(valid)


def parse_station_info(feed: DataFrame, tally: Observation | None = None) -> DataFrame:
    """Station metadata; entries without id or with unusable or placeholder coordinates are skipped."""
    rows = _stations(feed).withColumns({"_lat": to_double(F.col("lat")), "_lon": to_double(F.col("lon"))})
    placeholder = (F.abs("_lat") < TINY) & (F.abs("_lon") < TINY)
    valid = _has_id() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull() & ~F.coalesce(placeholder, F.lit(False))
    return _keep(rows, valid, tally).select(
        "station_id",
        F.trim("short_name").alias("short_name"),
        "name",
        F.col("_lat").alias("lat"),
        F.col("_lon").alias("lon"),
        to_int(F.col("capacity"), 0).alias("capacity"),
        "region_id",
    )


def parse_station_status(
    feed: DataFrame, snapshot_ts: datetime | Column | None = None, tally: Observation | None = None
) -> DataFrame:
    """One inventory row per station; entries without id or bike count are skipped.

    The time is the given one, else the document's own, else now.
    """
    if snapshot_ts is None:
        seen = F.coalesce(_epoch(F.col("last_updated")), F.current_timestamp())
    else:
        seen = snapshot_ts if isinstance(snapshot_ts, Column) else F.lit(snapshot_ts)
    rows = _stations(feed).withColumn("_bikes", to_int(F.col("num_bikes_available")))
    kept = _keep(rows, _has_id() & F.col("_bikes").isNotNull(), tally)
    return kept.select(
        "station_id",
        F.col("_bikes").alias("num_bikes_available"),
        *[to_int(F.col(c), 0).alias(c) for c in COUNTS],
        *[to_flag(F.col(c)).alias(c) for c in FLAGS],
        _epoch(F.col("last_reported")).alias("last_reported"),
        seen.cast("timestamp").alias("snapshot_ts"),
    )


def live_short_names(info: DataFrame) -> DataFrame:
    return info.select("short_name").where("short_name <> ''").distinct()
