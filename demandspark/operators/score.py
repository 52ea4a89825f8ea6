"""Batch scoring: history in, forecasts with coordinates out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.times import floor_hour, minutes_between
from demandspark.operators.entities import to_entities
from demandspark.operators.panel import feature_panel
from demandspark.operators.train import predict
from demandspark.params import Params


def latest_hour(hourly: DataFrame) -> DataFrame:
    return hourly.agg(F.max("hour_ts").alias("latest"))


def check_horizon(requests: DataFrame, latest: DataFrame, params: Params) -> DataFrame:
    """``(target_hour, hours_ahead, status)`` per request: ``ok``, ``warn`` past one hour, ``reject`` past the horizon.

    A request without an hour asks for the one after the newest observation.
    """
    newest = latest.select("latest").scalar()
    asked = requests.withColumn("_latest", newest)
    default = F.timestamp_add("HOUR", F.lit(1), floor_hour("_latest"))
    target = F.coalesce(floor_hour("requested_hour"), default)
    ahead = minutes_between(F.col("_latest"), F.col("target_hour")) / 60.0
    status = (
        F.when(F.col("hours_ahead") > params.max_forecast_horizon_hours, "reject")
        .when(F.col("hours_ahead") > 1, "warn")
        .otherwise("ok")
    )
    return (
        asked.withColumn("target_hour", target).withColumn("hours_ahead", ahead).withColumn("status", status).drop("_latest")
    )


def scoring_panel(
    history: DataFrame, station_entity: DataFrame, entities: DataFrame, weather: DataFrame | None,
    targets: Sequence[datetime], params: Params,
) -> DataFrame:
    """Feature rows of the target hours, from the same builder as training."""
    obs = to_entities(history, station_entity)
    panel = feature_panel(obs, entities, weather, params, extra_hours=targets)
    wanted = [F.lit(str(t)).cast("timestamp_ntz") for t in targets]
    return panel.where(F.col("hour_ts").isin(*wanted))


def score(
    panel: DataFrame, entities: DataFrame, model: Transformer, wanted: DataFrame | None = None
) -> DataFrame:
    """``(entity_id, target_hour_ts, predicted, lat, lon, n_stations)``, optionally for some entities only."""
    if wanted is not None:
        panel = panel.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")
    scored = predict(model, panel)
    return scored.select("entity_id", F.col("hour_ts").alias("target_hour_ts"), F.round("predicted", 3).alias("predicted")).join(
        entities.select("entity_id", "lat", "lon", "n_stations"), "entity_id", "left"
    )


def prediction_log(scored: DataFrame, model_name: str, model_version: str) -> DataFrame:
    """Rows for the ``predictions`` table."""
    return scored.select(
        "entity_id", "target_hour_ts", "predicted", F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"), F.current_timestamp().alias("predicted_at"),
    )
