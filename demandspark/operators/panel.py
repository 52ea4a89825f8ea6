"""Dense hourly panel and its leak-free features.

An entity has one row per hour, so an entity's window never holds more rows than the time
range has hours, however the raw events are skewed. The whole panel costs one shuffle by
entity: gap filling is an explode of the hours up to the next observation, not a grid join.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from demandspark.functions.calendar import add_calendar, add_seasonal
from demandspark.functions.times import floor_hour, hour_from_index, hour_index
from demandspark.operators.keys import first_per_key
from demandspark.params import ENTITY_FEATURES, WEATHER_FEATURES, Params

KEYS = ["entity_id", "hour_ts"]
TARGET = "departures"


def complete_panel(
    obs: DataFrame, params: Params, extra_hours: Sequence[datetime] | None = None, bounds: DataFrame | None = None
) -> DataFrame:
    """``(entity_id, hour_ts, departures, missing_run_length)`` for every entity and hour.

    Runs of missing hours up to ``max_gap_fill_hours`` become 0, longer runs and hours past
    the last observation stay NULL. ``missing_run_length`` is 0 for observed hours and NULL
    past the end. ``obs`` holds one known value per entity and hour. ``bounds`` may name a
    cheaper frame with an ``hour_ts`` column to take the first and last hour from.
    """
    known = obs.where(F.col(TARGET).isNotNull()).select("entity_id", "hour_ts", TARGET)
    span = (bounds if bounds is not None else known).agg(F.min("hour_ts").alias("lo"), F.max("hour_ts").alias("hi"))
    empty = F.raise_error(F.lit("cannot build a feature panel from zero observations")).cast("bigint")
    first = span.select(F.coalesce(hour_index("lo"), empty)).scalar()
    last_seen = span.select(hour_index("hi")).scalar()
    placed = known.select(
        "entity_id", TARGET, hour_index("hour_ts").alias("_h"), first.alias("_start"), last_seen.alias("_seen_end")
    )
    start, seen_end = F.col("_start"), F.col("_seen_end")
    end = seen_end
    if extra_hours:
        end = F.greatest(seen_end, hour_index(F.lit(str(max(extra_hours))).cast("timestamp_ntz")))

    w = Window.partitionBy("entity_id").orderBy("_h")
    linked = placed.select(
        "entity_id", TARGET, "_h", "_start", "_seen_end",
        F.lag("_h").over(w).alias("_prev"),
        F.lead("_h").over(w).alias("_next"),
    )
    hours = F.sequence(
        F.when(F.col("_prev").isNull(), start).otherwise(F.col("_h")),
        F.coalesce(F.col("_next") - 1, end),
    )
    dense = linked.select("*", F.explode(hours).alias("_g"))
    gap = F.when(F.col("_g") == F.col("_h"), F.lit(0)).when(
        F.col("_g") < F.col("_h"), F.col("_h") - start
    ).when(F.col("_g") <= seen_end, F.coalesce(F.col("_next"), seen_end + 1) - F.col("_h") - 1)
    filled = (
        F.when(F.col("_g") == F.col("_h"), F.col(TARGET).cast("double"))
        .when(F.col("_gap") <= params.max_gap_fill_hours, F.lit(0.0))
    )
    return dense.withColumn("_gap", gap).select(
        "entity_id",
        hour_from_index("_g").alias("hour_ts"),
        filled.alias(TARGET),
        F.col("_gap").cast("bigint").alias("missing_run_length"),
    )


def gap_runs(panel: DataFrame) -> DataFrame:
    """Islands of missing hours: ``(entity_id, gap_start, gap_end, gap_hours)``."""
    w = Window.partitionBy("entity_id").orderBy("hour_ts")
    missing = F.col("missing_run_length") > 0
    flagged = panel.where("missing_run_length is not null").withColumn("_missing", missing)
    starts = flagged.withColumn(
        "_start", (F.col("_missing") & ~F.coalesce(F.lag("_missing").over(w), F.lit(False))).cast("int")
    )
    numbered = starts.withColumn("_run", F.sum("_start").over(w)).where("_missing")
    return numbered.groupBy("entity_id", "_run").agg(
        F.min("hour_ts").alias("gap_start"), F.max("hour_ts").alias("gap_end"), F.count("*").alias("gap_hours")
    ).drop("_run")


def _hourly() -> WindowSpec:
    return Window.partitionBy("entity_id").orderBy("hour_ts")


def add_lags(panel: DataFrame, params: Params) -> DataFrame:
    """``lag_<h>h``: the value h hours earlier (the panel is dense, so positional)."""
    w = _hourly()
    return panel.withColumns({f"lag_{h}h": F.lag(TARGET, h).over(w) for h in params.lag_hours})


def add_rolling(panel: DataFrame, params: Params, method: str = "prefix") -> DataFrame:
    """Mean and sample deviation of the ``w`` hours before each hour, never including it.

    NULL unless at least ``max(2, w // 4)`` of those hours are known. ``prefix`` takes
    differences of running sums and costs the same for any ``w``; ``frame`` lets Spark
    re-aggregate a sliding frame and is the plain statement of the same thing.
    """
    w = _hourly()
    if method == "frame":
        columns = {}
        for size in params.rolling_windows_hours:
            frame = w.rowsBetween(-size, -1)
            enough = F.count(TARGET).over(frame) >= max(2, size // 4)
            columns[f"roll_mean_{size}h"] = F.when(enough, F.avg(TARGET).over(frame))
            columns[f"roll_std_{size}h"] = F.when(enough, F.stddev_samp(TARGET).over(frame))
        return panel.withColumns(columns)
    if method != "prefix":
        raise ValueError(f"unknown rolling method {method!r}")

    past = w.rowsBetween(Window.unboundedPreceding, -1)
    y = F.col(TARGET)
    sums = panel.withColumns(
        {
            "_n": F.count(y).over(past),
            "_s": F.coalesce(F.sum(y).over(past), F.lit(0.0)),
            "_q": F.coalesce(F.sum(y * y).over(past), F.lit(0.0)),
        }
    )
    older = {f"_{c}{size}": F.lag(f"_{c}", size, 0).over(w) for size in params.rolling_windows_hours for c in "nsq"}
    sums = sums.withColumns(older)
    columns = {}
    for size in params.rolling_windows_hours:
        n, s, q = (F.col(f"_{c}") - F.col(f"_{c}{size}") for c in "nsq")
        enough = n >= max(2, size // 4)
        variance = F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))
        columns[f"roll_mean_{size}h"] = F.when(enough, s / n)
        columns[f"roll_std_{size}h"] = F.when(enough, F.sqrt(variance))
    return sums.withColumns(columns).drop("_n", "_s", "_q", *older)


def add_entities(panel: DataFrame, entities: DataFrame) -> DataFrame:
    """Left join of the entity metadata, first row per entity; absent columns are simply not added.

    No broadcast hint: Spark broadcasts by measured size.
    """
    present = [c for c in ENTITY_FEATURES if c in entities.columns]
    meta = first_per_key(entities.select("entity_id", *present), ["entity_id"], present)
    return panel.join(meta, "entity_id", "left")


def add_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join of hourly weather, one row per hour."""
    present = [c for c in WEATHER_FEATURES if c in weather.columns]
    hourly = first_per_key(weather.select("hour_ts", *present), ["hour_ts"], present)
    return panel.join(hourly, "hour_ts", "left")


def to_contract(panel: DataFrame, params: Params, strict: bool = False) -> DataFrame:
    """Keys, target and the ordered features as doubles; absent entity and weather columns become NULL."""
    optional = set(ENTITY_FEATURES) | set(WEATHER_FEATURES)
    absent = [c for c in params.features if c not in panel.columns]
    broken = absent if strict else [c for c in absent if c not in optional]
    if broken:
        raise ValueError(f"panel lacks required features: {broken}")
    columns = [
        (F.lit(None) if c in absent else F.col(c)).cast("double").alias(c) for c in params.features
    ]
    return panel.select(*KEYS, TARGET, *columns)


def feature_panel(
    obs: DataFrame,
    entities: DataFrame,
    weather: DataFrame | None,
    params: Params,
    extra_hours: Sequence[datetime] | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """The one function that turns history into model input, for training and scoring alike."""
    panel = complete_panel(obs, params, extra_hours, bounds).drop("missing_run_length")
    panel = add_rolling(add_lags(panel, params), params)
    panel = add_calendar(panel, params)
    if params.seasonal_features:
        panel = add_seasonal(panel, params)
    panel = add_entities(panel, entities)
    if weather is not None:
        panel = add_weather(panel, weather)
    return to_contract(panel, params)


def drop_warmup(panel: DataFrame, params: Params, bounds: DataFrame | None = None) -> DataFrame:
    """Keep hours from ``warmup`` after the first one, which ``bounds`` may give more cheaply than the panel."""
    first = floor_hour(F.min("hour_ts"))
    cutoff = (panel if bounds is None else bounds).agg(F.timestamp_add("HOUR", F.lit(params.warmup), first)).scalar()
    return panel.where(F.col("hour_ts") >= cutoff)


def known_target(panel: DataFrame) -> DataFrame:
    return panel.where(F.col(TARGET).isNotNull())


def between_hours(df: DataFrame, start: datetime | Column, end: datetime | Column, ts: str = "hour_ts") -> DataFrame:
    """Closed range on an hour column."""
    start, end = (v if isinstance(v, Column) else F.lit(str(v)).cast("timestamp_ntz") for v in (start, end))
    return df.where(F.col(ts).between(start, end))


def tail_per_entity(df: DataFrame, n: int) -> DataFrame:
    """Last n rows of every entity."""
    w = Window.partitionBy("entity_id").orderBy(F.col("hour_ts").desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_context(split: DataFrame, history: DataFrame | None, n: int) -> DataFrame:
    """The split's rows plus the last n history rows per entity, marked by ``is_split_row``."""
    own = split.withColumn("is_split_row", F.lit(True))
    if history is None:
        return own
    context = tail_per_entity(history, n).withColumn("is_split_row", F.lit(False))
    return own.unionByName(context, allowMissingColumns=True)


def sequences(panel: DataFrame, length: int, target_flag: str | None = None) -> DataFrame:
    """``(entity_id, hour_ts, sequence, target)``: the ``length`` values before each hour.

    Hours with an unknown value in the window, an unknown target or too little history are skipped.
    """
    frame = _hourly().rowsBetween(-length, -1)
    keep = [target_flag] if target_flag else []
    built = panel.select(
        *KEYS, *keep, F.col(TARGET).alias("target"), F.collect_list(TARGET).over(frame).alias("sequence")
    )
    # collect_list leaves NULLs out, so a full-length list means no unknown hour.
    usable = (F.size("sequence") == length) & F.col("target").isNotNull()
    if target_flag:
        usable = usable & F.col(target_flag)
    return built.where(usable).select(*KEYS, "sequence", "target")


def largest_gap(df: DataFrame) -> DataFrame:
    """``(gap_hours, gap_end)`` of the widest hole between consecutive distinct hours."""
    hours = df.select("hour_ts").distinct()
    # Only distinct hours are left, so this one window holds at most the hours of the time range.
    w = Window.orderBy("hour_ts")
    steps = hours.select(
        "hour_ts", F.timestamp_diff("HOUR", F.lag("hour_ts").over(w), F.col("hour_ts")).alias("gap_hours")
    ).where("gap_hours is not null")
    return steps.agg(
        F.max("gap_hours").alias("gap_hours"),
        F.min_by("hour_ts", F.struct((-F.col("gap_hours")).alias("g"), F.col("hour_ts").alias("t"))).alias("gap_end"),
    )


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(*KEYS)

