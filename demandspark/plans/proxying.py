"""Queries: inventory snapshots to the demand proxy, in batch and on the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.times import micros, utc_wall
from demandspark.operators import proxy as px
from demandspark.params import Params
from demandspark.plans import testbed as tb
from demandspark.plans.registry import query
from demandspark.session import scratch
from demandspark.sinks.tables import write_table
from demandspark.streaming import intervals as si
from demandspark.streaming import ordered as so
from demandspark.streaming import rederive as sr
from demandspark.streaming import snapshots as ss

P = tb.PROXY_PARAMS
# Slices of the stream must be at least as wide as the largest usable gap.
STREAM = Params(
    max_gap_minutes=60.0, max_staleness_minutes=60.0, sample_spacing_seconds=3600.0, slice_minutes=60,
    late_snapshot_delay="11 days",
)
_TZ = "America/New_York"


def _pairs_sql(max_gap: float) -> str:
    return f"""linked AS (
  SELECT *, lag(num_bikes_available) OVER w AS prev_bikes, lag(snapshot_ts) OVER w AS prev_ts,
         lag(is_renting) OVER w AS prev_renting, lag(is_installed) OVER w AS prev_installed
  FROM snapshots WINDOW w AS (PARTITION BY station_id ORDER BY snapshot_ts, num_bikes_available)),
pairs AS (
  SELECT station_id, snapshot_ts AS interval_end, CAST(least(greatest(prev_bikes - num_bikes_available, 0), 10) AS DOUBLE) AS proxy_departures,
         date_diff('microsecond', prev_ts, snapshot_ts) / 60000000.0::DOUBLE AS interval_minutes,
         prev_bikes - num_bikes_available > 10 AS capped,
         CASE WHEN NOT (snapshot_ts > prev_ts AND date_diff('microsecond', prev_ts, snapshot_ts) <= {max_gap} * CAST(60000000 AS BIGINT)) THEN 'implausible_interval_length'
              WHEN NOT (is_renting = 1 AND prev_renting = 1) THEN 'station_not_renting'
              WHEN NOT (is_installed = 1 AND prev_installed = 1) THEN 'station_not_installed'
              WHEN date_diff('microsecond', last_reported, snapshot_ts) > 60 * CAST(60000000 AS BIGINT) THEN 'stale_last_reported' END AS reject_reason
  FROM linked WHERE prev_ts IS NOT NULL),
intervals AS (SELECT station_id, interval_end, proxy_departures, interval_minutes FROM pairs WHERE reject_reason IS NULL)"""


_PAIRS = tb.with_(tb.SNAPSHOTS, _pairs_sql(1440))
_INTERVAL_OUT = "SELECT station_id, interval_end, proxy_departures, round(interval_minutes, 4) AS interval_minutes FROM intervals"


def _hours_sql(expected: float) -> str:
    return f"""totals AS (
  SELECT station_id, date_trunc('hour', (interval_end AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}') AS hour_ts,
         sum(proxy_departures) AS departures, count(*) AS n_intervals FROM intervals GROUP BY 1, 2),
hourly_proxy AS (
  SELECT short_name AS station_short_name, hour_ts, departures, n_intervals FROM totals JOIN stations USING (station_id)
  WHERE n_intervals / {expected} >= 0.5 AND c_nation <> 5)"""


_INFO = tb.STATIONS.replace("c_mktsegment AS entity_id", "c_mktsegment AS entity_id, c_nationkey AS c_nation")


def _info(spark: SparkSession, d: str) -> DataFrame:
    """Station metadata in which some stations have no short name."""
    return tb.info(spark, d).withColumn("short_name", F.when(F.col("region_id") != "5", F.col("short_name")))


@query("WIN-01 JOIN-15 FLT-05 FLT-06 FLT-07 FLT-08 SCL-12 SCL-14", _PAIRS + _INTERVAL_OUT)
def interval_departures(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(px.interval_departures(tb.snapshots(spark, d), P), 4, "interval_minutes")


@query("WIN-01 JOIN-15", tb.with_(tb.SNAPSHOTS, _pairs_sql(60)) + _INTERVAL_OUT)
def interval_departures_sliced(spark: SparkSession, d: str) -> DataFrame:
    """The same differences with one-hour slices: most rows take their predecessor from another slice."""
    return tb.rounded(px.interval_departures(tb.snapshots(spark, d), STREAM), 4, "interval_minutes")


@query(
    "FLT-09",
    _PAIRS
    + "SELECT coalesce(reject_reason, CASE WHEN capped THEN 'capped_implausible_drop' ELSE 'usable' END) AS reject_reason, count(*) AS n FROM pairs GROUP BY 1",
)
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return px.reject_counts(px.interval_pairs(tb.snapshots(spark, d), P))


@query(
    "AGG-03 FLT-10 JOIN-01 SCL-04",
    tb.with_(tb.SNAPSHOTS, _pairs_sql(1440), _INFO, _hours_sql(4.0)) + "SELECT * FROM hourly_proxy",
)
def hourly_proxy(spark: SparkSession, d: str) -> DataFrame:
    return px.hourly_proxy(px.interval_departures(tb.snapshots(spark, d), P), _info(spark, d), P)


@query(
    "AGG-09",
    _PAIRS
    + """SELECT count(*) AS n_intervals, round(avg(CASE WHEN proxy_departures = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share,
round(avg(proxy_departures), 6) AS mean_proxy_departures, round(quantile_cont(proxy_departures, 0.99), 6) AS p99_proxy_departures,
count(DISTINCT station_id) AS n_stations FROM intervals""",
)
def proxy_quality(spark: SparkSession, d: str) -> DataFrame:
    out = px.proxy_quality(px.interval_departures(tb.snapshots(spark, d), P))
    return tb.rounded(out, 6, "zero_share", "mean_proxy_departures", "p99_proxy_departures")


_CLOSED = f"""SELECT station_short_name, hour_ts, departures, n_intervals FROM hourly_proxy
WHERE hour_ts < (SELECT date_trunc('hour', (max(snapshot_ts) AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}') FROM snapshots)"""


@query("FLT-11", tb.with_(tb.SNAPSHOTS, _pairs_sql(60), _INFO, _hours_sql(1.0)) + _CLOSED)
def closed_hours(spark: SparkSession, d: str) -> DataFrame:
    snaps = tb.snapshots(spark, d)
    hours = px.hourly_proxy(px.interval_departures(snaps, STREAM), _info(spark, d), STREAM)
    return px.drop_open_hour(hours, px.newest_snapshot_hour(snaps, STREAM))


@query(
    "STR-06 FLT-11",
    tb.with_(tb.SNAPSHOTS, _pairs_sql(60), _INFO, _hours_sql(1.0))
    + f"""SELECT station_short_name, hour_ts, departures, n_intervals FROM hourly_proxy
WHERE hour_ts >= date_trunc('hour', (TIMESTAMP '{tb.NOW}' AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}') - INTERVAL 48 HOUR
AND hour_ts < date_trunc('hour', ((SELECT max(snapshot_ts) FROM snapshots) AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}')""",
)
def rederived_window(spark: SparkSession, d: str) -> DataFrame:
    """The last 48 hours derived again: equal to the same hours of a full derivation, the first one included."""
    return px.rederive(tb.snapshots(spark, d), _info(spark, d), tb.NOW, STREAM.but(derive_lookback_hours=48))


# --- streams ------------------------------------------------------------------------------------

# Some two million snapshots a micro-batch, whatever the number of files that a week lands in.
TRIGGER_BYTES = 64 << 20
SNAPSHOT_SCHEMA = "station_id string, snapshot_ts timestamp, num_bikes_available int, is_renting int, is_installed int, last_reported timestamp"


def _instants(spark: SparkSession, d: str) -> DataFrame:
    snaps = tb.snapshots(spark, d)
    return snaps.withColumns({c: F.timestamp_micros(micros(c)) for c in ("snapshot_ts", "last_reported")})


def _landed(spark: SparkSession, d: str, name: str, closing: bool = True, copies: int = 1) -> str:
    """Snapshots landed as files week by week, unordered within a week, so that no row is more than a week late however
    long the table is; then, to let the last hours close, one far later snapshot. The table is read once and parted by
    week on the way, so that each week reads its own rows only."""
    path, parted = scratch(spark, name), scratch(spark, f"{name}-weeks")
    snaps = _instants(spark, d)
    day = F.to_date(utc_wall(snaps, "snapshot_ts"))
    first = snaps.agg(F.min(day)).scalar()
    dated = snaps.where("snapshot_ts is not null").withColumn("week", F.floor(F.datediff(day, first) / 7))
    dated.hint("rebalance", "week").write.partitionBy("week").parquet(parted)
    weeks = spark.read.schema(dated.schema).parquet(parted)
    for week in range((weeks.agg(F.max("week")).first()[0] or 0) + 1):
        part = weeks.where(F.col("week") == week).drop("week").repartition("snapshot_ts")
        for _ in range(copies):
            part.write.mode("append").parquet(path)
    if closing:
        last = snaps.agg(F.max("snapshot_ts").alias("t")).select(
            F.lit("closing").alias("station_id"), F.timestamp_add("DAY", F.lit(60), "t").alias("snapshot_ts"),
            F.lit(0).alias("num_bikes_available"), F.lit(1).alias("is_renting"), F.lit(1).alias("is_installed"),
            F.lit(None).cast("timestamp").alias("last_reported"),
        )
        last.coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark: SparkSession, path: str) -> DataFrame:
    return ss.table_stream(spark, path, SNAPSHOT_SCHEMA, max_bytes=TRIGGER_BYTES)


@query(
    "STR-01 STR-09 STR-10",
    """SELECT 'id-' || CAST(user_id AS VARCHAR) AS station_id, CAST(floor(value) AS INTEGER) AS num_bikes_available,
epoch_ms(CAST(1704067200000 + event_id * 1000 AS BIGINT)) AS snapshot_ts, (SELECT count(*) FROM events) AS documents,
(SELECT count(*) FROM events WHERE event_type = 'view') AS empty_documents, (SELECT count(*) FROM events WHERE event_type = 'error') AS rejected_entries
FROM events WHERE event_type NOT IN ('error', 'view')""",
)
def stream_feed(spark: SparkSession, d: str) -> DataFrame:
    """Status documents as a stream: broken entries and empty documents are skipped and counted, not fatal."""
    entry = F.struct(
        F.concat(F.lit("id-"), F.col("user_id").cast("string")).alias("station_id"),
        F.when(F.col("event_type") == "error", F.lit("broken")).otherwise(F.floor("value").cast("string")).alias("num_bikes_available"),
    )
    listed = F.when(F.col("event_type") != "view", F.struct(F.array(entry).alias("stations")))
    docs = tb.load(spark, d, "events").select((F.lit(1704067200) + F.col("event_id")).alias("last_updated"), listed.alias("data"))
    landing, out = scratch(spark, "feed"), scratch(spark, "feed-out")
    docs.write.json(landing)
    tally = ss.counters(ss.run_available(ss.snapshot_stream(spark, landing, one_per_file=False), out, f"{out}-state"))
    rows = spark.read.parquet(out)
    counts = [F.lit(tally[c]).cast("bigint").alias(c) for c in ("documents", "empty_documents", "rejected_entries")]
    return rows.select("station_id", "num_bikes_available", utc_wall(rows, "snapshot_ts").alias("snapshot_ts"), *counts)


@query(
    "STR-02",
    tb.with_(tb.SNAPSHOTS) + "SELECT station_id, snapshot_ts, num_bikes_available FROM snapshots",
)
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every week lands twice and is stored once."""
    path, out = _landed(spark, d, "dedupe", closing=False, copies=2), scratch(spark, "dedupe-out")
    ss.require_complete(ss.run_available(ss.dedupe(_stream(spark, path), STREAM), out, f"{out}-state"))
    rows = spark.read.parquet(out)
    return rows.select("station_id", utc_wall(rows, "snapshot_ts").alias("snapshot_ts"), "num_bikes_available")


@query("STR-03", tb.with_(tb.SNAPSHOTS, _pairs_sql(60)) + _INTERVAL_OUT)
def stream_interval_diff(spark: SparkSession, d: str) -> DataFrame:
    path, out = _landed(spark, d, "diff"), scratch(spark, "diff-out")
    ss.require_complete(ss.run_available(si.stream_intervals(_stream(spark, path), STREAM), out, f"{out}-state"))
    rows = spark.read.parquet(out)
    rows = rows.withColumn("interval_end", utc_wall(rows, "interval_end"))
    return tb.rounded(rows, 4, "interval_minutes")


@query("STR-03", tb.with_(tb.SNAPSHOTS, _pairs_sql(1440)) + _INTERVAL_OUT)
def stream_ordered_diff(spark: SparkSession, d: str) -> DataFrame:
    """The same from ordered state per station: pairs may lie a day apart, and the stream equals the batch."""
    path, out = _landed(spark, d, "ordered"), scratch(spark, "ordered-out")
    stream = so.ordered_intervals(_stream(spark, path), P.but(late_snapshot_delay=STREAM.late_snapshot_delay))
    with so.state_store(spark):
        ss.require_complete(ss.run_available(stream, out, f"{out}-state"))
    rows = spark.read.parquet(out)
    rows = rows.withColumn("interval_end", utc_wall(rows, "interval_end"))
    return tb.rounded(rows, 4, "interval_minutes")


@query(
    "STR-04 STR-05",
    tb.with_(tb.SNAPSHOTS, _pairs_sql(60), _INFO, _hours_sql(1.0)) + "SELECT * FROM hourly_proxy",
)
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hours leave the stream once, when the watermark has passed them."""
    path, out = _landed(spark, d, "hours"), scratch(spark, "hours-out")
    stream = si.stream_intervals(_stream(spark, path), STREAM)
    writer = stream.writeStream.foreachBatch(si.hourly_writer(out, STREAM)).option("checkpointLocation", f"{out}-state")
    ss.require_complete(ss.run(writer.trigger(availableNow=True)))
    return si.finish_hourly(spark.read.parquet(out), _info(spark, d), STREAM)


@query(
    "STR-07 SNK-08",
    tb.with_(tb.SNAPSHOTS)
    + f"""SELECT date_trunc('day', snapshot_ts)::TIMESTAMP AS day, count(*) FILTER (WHERE snapshot_ts >= TIMESTAMP '{tb.NOW}' - INTERVAL 30 HOUR) AS kept_rows,
count(*) FILTER (WHERE snapshot_ts < TIMESTAMP '{tb.NOW}' - INTERVAL 30 HOUR) AS removed_rows,
count(*) FILTER (WHERE snapshot_ts >= TIMESTAMP '{tb.NOW}' - INTERVAL 30 HOUR) AS stored_rows FROM snapshots GROUP BY 1""",
)
def stored_retention(spark: SparkSession, d: str) -> DataFrame:
    """Retention of the stored snapshot log: old days are dropped as partitions, the day of the cutoff is rewritten, and
    what the table holds afterwards is what was to be kept."""
    path = scratch(spark, "snapshots")
    snaps = _instants(spark, d)
    stored = snaps.withColumns({"day": F.to_date(utc_wall(snaps, "snapshot_ts")), "batch": F.lit(0)})
    write_table(stored, path, ["day", "batch"], ["station_id"])
    report = sr.expire_snapshots(spark, path, tb.NOW, STREAM.but(snapshot_retention_hours=30.0))
    left = spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("stored_rows"))
    out = report.join(left, "day", "left").withColumn("stored_rows", F.coalesce("stored_rows", F.lit(0)))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("STR-06 STR-08 SNK-03", tb.with_(tb.SNAPSHOTS, _pairs_sql(60), _INFO, _hours_sql(1.0)) + _CLOSED)
def stream_rederive(spark: SparkSession, d: str) -> DataFrame:
    """Disordered micro-batches, each deriving the hours it touches again: the log's newest versions equal the batch result."""
    path, base = _landed(spark, d, "late", closing=False), scratch(spark, "late-out")
    process = sr.rederive_batch(f"{base}/snapshots", f"{base}/hourly", lambda s: _info(s, d), STREAM)
    started = (
        _stream(spark, path).writeStream.foreachBatch(process).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    started.awaitTermination()
    log = spark.read.parquet(f"{base}/hourly")
    return sr.current_hours(log).select("station_short_name", "hour_ts", "departures", "n_intervals")
