"""Rolling accuracy, breach rule, cooldown, retrain decision, freshness and health."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.stats import regression_aggregates
from demandspark.functions.times import floor_hour, hours_before, minutes_between, utc_wall
from demandspark.params import Params

SUPPRESSED = "[suppressed]"


def utc_now(now: datetime | str | None = None) -> Column:
    """UTC wall clock, fixed for reproducible runs or taken from the cluster."""
    if now is None:
        return F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    return F.lit(str(now)).cast("timestamp_ntz")


def local_now(now: datetime | str | None, params: Params) -> Column:
    """The same moment in the zone of the hour buckets; comparing them with UTC would be hours off."""
    return F.convert_timezone(F.lit("UTC"), F.lit(params.timezone), utc_now(now))


def rolling_accuracy(matched: DataFrame, now: datetime | str | None, params: Params) -> DataFrame:
    """One row of errors over the last complete hours; too few pairs are reported, not judged."""
    end = floor_hour(local_now(now, params))
    start = hours_before(end, params.mae_window_hours)
    recent = matched.where((F.col("target_hour_ts") >= start) & (F.col("target_hour_ts") < end))
    wanted = [a for a in regression_aggregates("actual", "predicted")]
    row = recent.agg(*wanted)
    enough = F.col("n") >= params.min_samples
    reason = F.when(F.col("n") == 0, "none_matched").when(~enough, "too_few_pairs")
    return row.select(
        start.alias("window_start"),
        end.alias("window_end"),
        F.col("n").alias("n_samples"),
        F.when(enough, F.col("mae")).alias("rolling_mae"),
        F.when(enough, F.col("rmse")).alias("rolling_rmse"),
        enough.alias("evaluated"),
        reason.alias("not_evaluated_reason"),
    )


def judge(mae: Column, reference_mae: Column, params: Params) -> Column:
    """Code of a breach or NULL: over the ceiling, or too far above the holdout error. Both strict."""
    return F.when(mae > params.mae_threshold, "above_ceiling").when(
        (reference_mae > 0) & (mae > reference_mae * params.mae_degradation_ratio), "above_holdout"
    )


def with_breach(accuracy: DataFrame, reference_mae: Column | float | None, params: Params) -> DataFrame:
    """Adds the holdout error, the code of a breach and whether there is one. Without a holdout error (no model) only
    the ceiling is judged."""
    ref = reference_mae if isinstance(reference_mae, Column) else F.lit(reference_mae).cast("double")
    judged = accuracy.withColumn("holdout_mae", ref)
    judged = judged.withColumn("breach_reason", judge(F.col("rolling_mae"), F.col("holdout_mae"), params))
    return judged.withColumn("breached", F.col("breach_reason").isNotNull())


def cooldown_left(history: DataFrame, now: datetime | str | None, params: Params) -> DataFrame:
    """One row ``(cooldown_hours)``: hours until another retrain may start, NULL when nothing limits it."""
    if params.retrain_cooldown_hours <= 0:
        return history.agg(F.lit(None).cast("double").alias("cooldown_hours"))
    fired = history.where(F.coalesce("breached", F.lit(False)) & ~F.coalesce(F.contains("breach_reason", F.lit(SUPPRESSED)), F.lit(False)))
    last = fired.agg(F.max(utc_wall(history, "computed_at")).alias("last"))
    left = F.lit(params.retrain_cooldown_hours) - minutes_between(F.col("last"), utc_now(now)) / 60.0
    return last.select(F.when(F.col("last").isNotNull(), F.greatest(left, F.lit(0.0))).alias("cooldown_hours"))


def retrain_decision(
    accuracy: DataFrame, drift: DataFrame, cooldown: DataFrame, params: Params, now: datetime | str | None = None,
    model: tuple[Column, Column] | None = None,
) -> DataFrame:
    """One ``model_metrics`` row with the drifted features beside it. ``breached`` is the decision to retrain; a retrain
    held back by the cooldown is stored as not breached and marked, so it does not prolong its own cooldown.

    ``model`` is the name and version of the live model; ``breach_reason`` lists what fired as ``trigger:code``.
    """
    d = drift.select(F.struct("drift_share", "dataset_drift", "evaluated", "drifted_features")).scalar()
    name, version = model or (F.lit(None), F.lit(None))
    row = accuracy.withColumns({"_d": d, "_cool": cooldown.select("cooldown_hours").scalar()})
    by_error = F.when(F.col("evaluated") & F.col("breached"), F.concat(F.lit("accuracy:"), F.col("breach_reason")))
    by_drift = F.when(F.col("_d.evaluated") & F.col("_d.dataset_drift"), "drift:share_above_limit")
    fired = F.col("_error").isNotNull() | F.col("_drift").isNotNull()
    held = fired & F.coalesce(F.col("_cool") > 0, F.lit(False))
    reason = F.when(fired, F.concat_ws("; ", "_error", "_drift", F.when(held, SUPPRESSED))).otherwise("none")
    return row.withColumns({"_error": by_error, "_drift": by_drift}).select(
        utc_now(now).alias("computed_at"), "window_start", "window_end", name.cast("string").alias("model_name"),
        version.cast("string").alias("model_version"), "n_samples", "rolling_mae", "rolling_rmse",
        F.col("_d.drift_share").alias("drift_share"), F.col("_d.dataset_drift").alias("dataset_drift"),
        (fired & ~held).alias("breached"), reason.alias("breach_reason"), F.col("_cool").alias("cooldown_hours"),
        F.col("_d.drifted_features").alias("drifted_features"),
    )


def store_metrics(decision: DataFrame, path: str) -> None:
    """Append the stored columns of a decision to the monitoring log, partitioned by day."""
    fields = [c for c in decision.columns if c not in ("cooldown_hours", "drifted_features")]
    row = decision.select(fields).withColumn("day", F.to_date("computed_at"))
    row.write.mode("append").partitionBy("day").parquet(path)


def freshness(
    streams: Mapping[str, tuple[DataFrame, str, float, bool]], now: datetime | str | None, params: Params
) -> DataFrame:
    """One row per stream: newest row, its age, the limit and a verdict.

    Each entry is ``(frame, time column, limit in minutes, is_local)``; local columns are compared
    with the local clock. A stream without rows is unhealthy.
    """
    rows = []
    for name, (df, ts, limit, is_local) in streams.items():
        clock = local_now(now, params) if is_local else utc_now(now)
        newest = df.agg(F.max(F.col(ts).cast("timestamp_ntz") if is_local else utc_wall(df, ts)).alias("latest"))
        rows.append(
            newest.select(
                F.lit(name).alias("name"), "latest", minutes_between(F.col("latest"), clock).alias("age_minutes"),
                F.lit(float(limit)).alias("threshold_minutes"),
            )
        )
    checked = reduce(DataFrame.unionByName, rows)
    healthy = F.coalesce(F.col("age_minutes") <= F.col("threshold_minutes"), F.lit(False))
    code = F.when(F.col("latest").isNull(), "no_rows").when(healthy, "fresh").otherwise("stale")
    return checked.withColumns({"healthy": healthy, "detail": F.concat_ws(":", "name", code)})


def overall_freshness(checks: DataFrame) -> DataFrame:
    """One row ``(healthy, summary)``; one line per configured stream goes in."""
    failing = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("healthy"), F.col("detail")))), ",")
    row = checks.agg(F.bool_and("healthy").alias("healthy"), failing.alias("failing"))
    return row.select("healthy", F.when(F.col("healthy"), "fresh").otherwise(F.col("failing")).alias("summary"))


#: Sources of history that are worth a warning.
DOUBTFUL_SOURCES = ("fallback", "stale", "none")


def health(checks: DataFrame, history_source: Column | str, model_loaded: bool = True) -> DataFrame:
    """One row ``(status, history_source, data_live, warnings)``: ok only without any warning."""
    source = F.lit(history_source) if isinstance(history_source, str) else history_source
    row = overall_freshness(checks).withColumn("history_source", source)
    notes = [F.when(~F.col("healthy"), F.concat(F.lit("streams "), F.col("summary")))]
    notes.append(F.when(F.col("history_source").isin(*DOUBTFUL_SOURCES), F.concat(F.lit("history "), F.col("history_source"))))
    if not model_loaded:
        notes.append(F.lit("model none"))
    listed = F.array_join(F.filter(F.array(*notes), lambda x: x.isNotNull()), "; ")
    return row.withColumn("warnings", listed).select(
        F.when(F.col("warnings") == "", "ok").otherwise("degraded").alias("status"),
        "history_source", F.col("healthy").alias("data_live"), "warnings",
    )


def metric_series(history: DataFrame, column: str) -> DataFrame:
    """A monitoring column over time, where it was measured."""
    return history.where(F.col(column).isNotNull()).select("computed_at", column).orderBy("computed_at")
