"""Chronological split, error metrics, baselines and predictions against what happened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.stats import METRICS, regression_aggregates
from demandspark.functions.times import floor_hour
from demandspark.operators.entities import to_entities
from demandspark.operators.keys import latest_per_key
from demandspark.operators.panel import largest_gap
from demandspark.params import Params
from demandspark.session import materialise

SPLITS = ("train", "validation", "test")


def chronological_split(panel: DataFrame, params: Params, bounds: DataFrame | None = None) -> DataFrame:
    """Add ``split``: the last hours are test, the hours before them validation, the rest train.

    ``bounds`` may name a cheaper frame with the observed hours, so that the panel is not built for its newest one.
    """
    newest = (panel if bounds is None else bounds).agg(floor_hour(F.max("hour_ts")).alias("m"))
    test_start = newest.select(F.timestamp_add("HOUR", F.lit(-params.test_size_hours), "m")).scalar()
    valid_start = newest.select(
        F.timestamp_add("HOUR", F.lit(-params.test_size_hours - params.validation_size_hours), "m")
    ).scalar()
    split = (
        F.when(F.col("hour_ts") >= test_start, "test")
        .when(F.col("hour_ts") >= valid_start, "validation")
        .otherwise("train")
    )
    return panel.withColumn("split", split)


def check_split(split: DataFrame, params: Params) -> None:
    """Raise when a part is empty, telling a short history from one with a hole."""
    present = {r["split"] for r in split.select("split").distinct().collect()}  # at most three values
    empty = [s for s in SPLITS if s not in present]
    if not empty:
        return
    span = split.agg(F.min("hour_ts").alias("lo"), F.max("hour_ts").alias("hi")).first()
    gap = largest_gap(split).first()
    text = (
        f"chronological split left empty parts {empty}: data spans {span['lo']} to {span['hi']} with "
        f"test_size_hours={params.test_size_hours} and validation_size_hours={params.validation_size_hours}."
    )
    if gap["gap_hours"] is not None and gap["gap_hours"] > 24:
        text += f" There is a gap of {gap['gap_hours']} hours ending {gap['gap_end']}, and a part falls inside it."
    else:
        text += " The available history is too short for these sizes."
    raise ValueError(text)


def dataset_summary(split: DataFrame) -> DataFrame:
    """Rows, entities and time bounds per split."""
    return split.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("entity_id").alias("n_entities"),
        F.min("hour_ts").alias("first_hour"),
        F.max("hour_ts").alias("last_hour"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Error metrics per group; rows without a prediction are left to :func:`coverage`."""
    usable = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return usable.groupBy(*by).agg(*regression_aggregates(actual, predicted))


def naive_baseline(df: DataFrame, by: Sequence[str] = (), lag: str = "lag_168h") -> DataFrame:
    """Metrics of predicting the same hour last week, where that is known."""
    metrics = regression_metrics(df, "departures", lag, by)
    return metrics.withColumnsRenamed({m: f"baseline_{m}" for m in METRICS})


def coverage(df: DataFrame, predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(F.col(predicted).isNotNull().cast("double")).alias("coverage"), F.count("*").alias("n_rows")
    )


def align_predictions(split: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every split row with its prediction, NULL where the model could not make one."""
    return split.join(predictions.select("entity_id", "hour_ts", "predicted"), ["entity_id", "hour_ts"], "left")


def standardise_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, mean, std)`` over the training rows; tiny deviations become 1."""
    long = train.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "col", "value")
    std = F.stddev_pop("value")
    return long.groupBy("col").agg(
        F.avg("value").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std")
    )


def target_scale(train: DataFrame) -> DataFrame:
    """One row: mean target, at least 1."""
    return train.agg(F.greatest(F.avg("departures"), F.lit(1.0)).alias("target_scale"))


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """The prediction being served per entity and hour: the one made last, as a whole row."""
    ties = [c for c in ("id", "model_version", "predicted") if c in predictions.columns]
    return latest_per_key(predictions, ["entity_id", "target_hour_ts"], ["predicted_at", *ties])


def match_predictions(predictions: DataFrame, hourly: DataFrame, station_entity: DataFrame) -> DataFrame:
    """Predictions with the realised value of their hour, rolled up through the frozen map."""
    actual = to_entities(hourly, station_entity).select(
        "entity_id", F.col("hour_ts").alias("target_hour_ts"), F.col("departures").alias("actual")
    )
    return latest_predictions(predictions).join(actual, ["entity_id", "target_hour_ts"])


def with_errors(matched: DataFrame) -> DataFrame:
    """Add error, its size and direction."""
    error = F.col("predicted") - F.col("actual")
    direction = F.when(error > 0, "over").when(error < 0, "under").otherwise("exact")
    return matched.withColumns({"error": error, "abs_error": F.abs(error), "direction": direction})


def error_profile(matched: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Mean absolute error and mean actual per group, e.g. per hour of day or per entity."""
    return with_errors(matched).groupBy(*[c.alias(n) for n, c in by.items()]).agg(
        F.avg("abs_error").alias("mae"), F.avg("actual").alias("mean_actual"), F.count("*").alias("n")
    )


def relative_error(by_entity: DataFrame) -> DataFrame:
    return by_entity.withColumn("relative_error", F.try_divide("mae", "mean_actual"))


def top_errors(matched: DataFrame, k: int = 15) -> DataFrame:
    """The k largest absolute errors at the newest matched hour. The match is written once and read twice, instead of
    being computed for its newest hour and again for its rows."""
    matched = materialise(matched, "matched")
    newest = matched.agg(F.max("target_hour_ts")).scalar()
    current = with_errors(matched.where(F.col("target_hour_ts") == newest))
    return current.orderBy(F.col("abs_error").desc(), "entity_id").limit(k)


def demand_over_time(matched: DataFrame) -> DataFrame:
    return matched.groupBy("target_hour_ts").agg(
        F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual")
    )


def comparison(matched: DataFrame, entities: DataFrame) -> DataFrame:
    """Matched predictions with coordinates for a map."""
    return with_errors(matched).join(entities.select("entity_id", "lat", "lon", "n_stations"), "entity_id", "left")
