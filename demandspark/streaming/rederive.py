"""Late data: every micro-batch stores its snapshots and derives the station-hours they touch again, and no others.

Both tables are append-only logs partitioned by batch, so a replayed batch overwrites only itself, and a lost executor
costs a task retry. The current value of a station-hour is its newest version; one without demand says that the hour is
no longer covered. A snapshot touches its own hour and those that its station's next usable snapshot can lie in, which
is at most ``max_gap_minutes`` later. Besides these, a batch derives the hours that it closes (whose first half may have
come earlier) and the look-back of stations that were given another name. What it reads of the log are the days and
stations of these hours, widened by the largest usable gap. All times are UTC wall clocks or those of the hour buckets,
so neither the driver's zone nor the session's matters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.times import EPOCH, floor_hour, hour_from_index, hour_index, hours_before, local_hour, micros, ntz, utc_wall
from demandspark.operators.keys import latest_per_key
from demandspark.operators.monitor import utc_now
from demandspark.operators.proxy import hourly_proxy, interval_departures
from demandspark.params import PROXY_LABEL, Params
from demandspark.session import materialise
from demandspark.sinks.tables import drop_partitions, write_table

KEY = ["station_short_name", "hour_ts"]
SNAPSHOT_KEY = ["station_id", "snapshot_ts"]
HALF_HOUR = 30 * 60_000_000


def _replace_own(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at a path; None where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _newest_before(spark: SparkSession, marks: str, batch_id: int):
    """Newest snapshot of all batches before this one, as UTC wall clock; None for the first."""
    log = _stored(spark, f"{marks}/batch={batch_id - 1}", "newest timestamp_ntz")
    return None if log is None else log.agg(F.max("newest")).first()[0]


def _to_utc(local: Column, timezone: str) -> Column:
    return F.convert_timezone(F.lit(timezone), F.lit("UTC"), local)


def _bucket_start(utc: Column, timezone: str) -> Column:
    """Where the hour bucket that holds a UTC wall clock begins, in UTC again: in zones with half hours not at :00."""
    local = floor_hour(F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc))
    return _to_utc(local, timezone)


def touched_hours(snaps: DataFrame, params: Params) -> DataFrame:
    """``(station_id, hour_ts)`` whose intervals the snapshots can change: at most the hours within ``max_gap_minutes``
    and half an hour after each. Zones are asked once per half hour of the batch, not per station: few, whatever the
    number of stations."""
    half = F.floor(micros(utc_wall(snaps, "snapshot_ts")) / F.lit(HALF_HOUR))
    starts = snaps.select("station_id", half.alias("_half")).distinct()
    steps = math.ceil(params.max_gap_minutes / 30) + 1
    at = starts.select("_half").distinct().select("_half", F.explode(F.sequence("_half", F.col("_half") + steps)).alias("_at"))
    utc = F.timestamp_add("MINUTE", (F.col("_at") * 30).cast("int"), F.expr(EPOCH))
    hours = at.select("_half", local_hour(utc, params.timezone).alias("hour_ts")).distinct()
    return starts.join(F.broadcast(hours), "_half").select("station_id", "hour_ts").distinct()


def read_slots(touched: DataFrame, params: Params) -> DataFrame:
    """``(station_id, slot)``: the UTC hours, as numbers, whose snapshots the touched hours are derived from."""
    start, end = (_to_utc(F.timestamp_add("HOUR", F.lit(n), "hour_ts"), params.timezone) for n in (0, 1))
    first = hour_index(hours_before(start, params.max_gap_minutes / 60))
    last = hour_index(F.timestamp_add("SECOND", F.lit(-1), end))
    slots = touched.select("hour_ts").distinct().select("hour_ts", F.explode(F.sequence(first, last)).alias("slot"))
    return touched.join(F.broadcast(slots), "hour_ts").select("station_id", "slot").distinct()


def _renamed(spark: SparkSession, info: DataFrame, path: str, batch_id: int) -> DataFrame:
    """``(station_id, short_name)`` that differ from what earlier batches were named by, kept in a log of changes."""
    names = info.dropna(subset=["short_name"]).select("station_id", "short_name")
    schema = "station_id string, short_name string, batch int"
    log = _stored(spark, path, schema)
    if log is not None:
        earlier = log.where(F.col("batch") < batch_id)
        names = names.join(latest_per_key(earlier, ["station_id"], ["batch"]).drop("batch"), ["station_id", "short_name"], "left_anti")
    _replace_own(names.withColumn("batch", F.lit(batch_id)), path, ["batch"])
    return spark.read.schema(schema).parquet(path).where(F.col("batch") == batch_id).drop("batch")


def rederive_batch(
    snapshots_path: str, hourly_path: str, read_info: Callable[[SparkSession], DataFrame], params: Params
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function. ``read_info`` is called per batch, so station changes are picked up; a short name
    belongs to one station.

    A snapshot that arrives again replaces the earlier one: of several batches the last counts, within a batch the one
    with the latest ``last_reported`` and then the largest values. Hours whose snapshots have been expired in part are
    left as they are. Rows read and written grow with the batch and the hours it closes, not with the log or look-back.
    """
    marks, names, expired = (f"{snapshots_path}_{kind}" for kind in ("marks", "names", "expired"))

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in SNAPSHOT_KEY]
        order = sorted(rest, key=lambda c: c != "last_reported")
        rows = latest_per_key(batch, SNAPSHOT_KEY, order).withColumns(
            {"day": F.to_date(utc_wall(batch, "snapshot_ts")), "batch": F.lit(batch_id)}
        )
        # Dealt by day: else every task of the batch would leave a file of its own in each day, all of which later
        # batches open again. Large days are split over several tasks.
        _replace_own(rows.hint("rebalance", "day"), snapshots_path, ["day", "batch"])
        stored = spark.read.schema(rows.schema).parquet(snapshots_path).where(F.col("batch") <= batch_id)
        clock = utc_wall(stored, "snapshot_ts")
        own = stored.where(F.col("batch") == batch_id)

        before = _newest_before(spark, marks, batch_id)
        earlier = F.lit(None).cast("timestamp_ntz") if before is None else ntz(before)
        # One row of wall clocks, which no zone changes on the way to the driver.
        seen = own.select(clock.alias("t")).agg(
            F.count("*").alias("n"), F.greatest(F.max("t"), earlier).alias("newest"),
        ).select("n", "newest", local_hour(F.col("newest"), params.timezone).alias("open_hour")).first()
        mark = earlier if seen.newest is None else ntz(seen.newest)
        _replace_own(spark.range(1).select(mark.alias("newest"), F.lit(batch_id).alias("batch")), marks, ["batch"])
        if not seen.n:
            return

        info = read_info(spark)
        changed = _renamed(spark, info, names, batch_id)
        hour = local_hour(clock, params.timezone)
        touched = touched_hours(own, params)
        if before is not None:
            # The hour that was open so far: all its snapshots lie at or after its start.
            since = _bucket_start(ntz(before), params.timezone)
            closing = stored.where((F.col("day") >= F.to_date(since)) & (clock >= since))
            touched = touched.union(closing.select("station_id", hour.alias("hour_ts")))
            back = _bucket_start(hours_before(ntz(seen.newest), params.derive_lookback_hours), params.timezone)
            recent = stored.where((F.col("day") >= F.to_date(back)) & (clock >= back)).join(changed, "station_id", "left_semi")
            touched = touched.union(recent.select("station_id", hour.alias("hour_ts")))
        touched = touched.where(F.col("hour_ts") < ntz(seen.open_hour))
        log = _stored(spark, expired, "cutoff timestamp_ntz")
        cutoff = None if log is None else log.agg(F.max("cutoff")).first()[0]
        if cutoff is not None:
            lead_in = hours_before(_to_utc(F.col("hour_ts"), params.timezone), params.max_gap_minutes / 60)
            touched = touched.where(lead_in >= ntz(cutoff))
        touched = materialise(touched.distinct(), "touched")

        slots = materialise(read_slots(touched, params), "slots")
        days = [r.day for r in slots.select(F.to_date(hour_from_index("slot")).alias("day")).distinct().collect()]
        window = stored.where(F.col("day").isin(days)).withColumn("slot", hour_index(clock))
        window = window.join(slots, ["station_id", "slot"], "left_semi").drop("slot")
        window = latest_per_key(window, SNAPSHOT_KEY, ["batch"]).drop("day", "batch")
        intervals = interval_departures(window, params)
        intervals = intervals.withColumn("hour_ts", local_hour(utc_wall(intervals, "interval_end"), params.timezone))
        intervals = intervals.join(touched, ["station_id", "hour_ts"], "left_semi").drop("hour_ts")
        hourly = hourly_proxy(intervals, info, params)
        known = info.dropna(subset=["short_name"]).select("station_id", F.col("short_name").alias("station_short_name"))
        said = touched.join(known, "station_id").select(*KEY).distinct().join(hourly, KEY, "left")
        # A batch that closes and changes nothing still gets its (empty) say: nothing is written for it.
        _replace_own(said.withColumns({"label_source": F.lit(PROXY_LABEL), "batch": F.lit(batch_id)}), hourly_path, ["batch"])

    return process


def current_hours(log: DataFrame) -> DataFrame:
    """Newest version of every station-hour that is covered."""
    return latest_per_key(log, [*KEY, "label_source"], ["batch"]).where(F.col("departures").isNotNull()).drop("batch")


def compact(log: DataFrame, target: str) -> None:
    """Write the current hours of a log to a fresh location, partitioned by month."""
    tagged = current_hours(log).withColumn("month", F.date_format("hour_ts", "yyyyMM"))
    write_table(tagged, target, ["month"], KEY, mode="errorifexists")


def expire_snapshots(spark: SparkSession, path: str, now, params: Params) -> DataFrame:
    """Remove the snapshots beyond the retention time from the stored log; ``(day, kept_rows, removed_rows)``.

    Days before the cutoff go as whole partitions, unread but for the count; only the cutoff's own day is rewritten,
    from a copy in the shared folder. Later days keep their files.
    """
    hours = params.snapshot_retention_hours
    limit = hours if hours is not None else params.snapshot_retention_days * 24
    stored = spark.read.parquet(path)
    cutoff = hours_before(utc_now(now), limit) if limit > 0 else F.lit("0001-01-01").cast("timestamp_ntz")
    old = utc_wall(stored, "snapshot_ts") < cutoff
    report = materialise(stored.groupBy("day").agg(F.count_if(~old).alias("kept_rows"), F.count_if(old).alias("removed_rows")), "expired")
    edge = F.to_date(cutoff)
    on_edge = materialise(stored.where((F.col("day") == edge) & ~old), "edge")
    rewritten = not report.where((F.col("day") == edge) & (F.col("removed_rows") > 0)).isEmpty()
    last = edge if rewritten else F.date_sub(edge, 1)
    drop_partitions(spark, path, "day", report.where(F.col("day") <= last).select(F.col("day").cast("string").alias("v")))
    if rewritten:
        on_edge.write.mode("append").partitionBy("day", "batch").parquet(path)
    # Re-derivation leaves hours alone that reach behind the last cutoff.
    spark.range(1).select(cutoff.alias("cutoff")).write.mode("append").parquet(f"{path}_expired")
    return report
