"""Predictions matched with realised demand as both arrive: the stream form of ``evaluate.match_predictions``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.times import micros, utc_wall
from demandspark.operators.entities import to_entities
from demandspark.operators.evaluate import latest_predictions


def _clocked(stream: DataFrame, hour: str, delay: str) -> DataFrame:
    """The hour bucket as an instant (its wall clock read as UTC), which watermarks need."""
    return stream.withColumn(hour, F.timestamp_micros(micros(utc_wall(stream, hour)))).withWatermark(hour, delay)


def match_stream(predictions: DataFrame, hourly: DataFrame, station_entity: DataFrame, delay: str) -> DataFrame:
    """Streaming ``(entity_id, target_hour_ts, predicted columns, actual)``, one row per predicted entity and hour.

    ``predictions`` has ``entity_id``, ``target_hour_ts``, ``predicted``, ``predicted_at`` and more; of several for one
    hour the last made is served. ``hourly`` has station-hours, summed through the frozen map; unknown stations are
    dropped. A row is emitted once the watermark has passed its hour, with a null ``actual`` if no demand came. The
    watermark is the slower one of both streams, each ``delay`` behind its newest hour.

    State: predictions from their arrival, and demand, until the watermark passes their hour. That is one row per entity
    for each hour of the forecast horizon plus the delay, whatever the length of the streams.
    """
    served = latest_predictions(_clocked(predictions, "target_hour_ts", delay))
    actual = to_entities(_clocked(hourly, "hour_ts", delay), station_entity).select(
        F.col("entity_id").alias("_entity"), F.col("hour_ts").alias("_hour"), F.col("departures").alias("actual")
    )
    on = (F.col("entity_id") == F.col("_entity")) & (F.col("target_hour_ts") == F.col("_hour"))
    return served.join(actual, on, "left").drop("_entity", "_hour")
