"""Queries: labels, stations, entities and the dense panel."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.coerce import cluster_id
from demandspark.functions.times import utc_wall
from demandspark.operators import entities as ent
from demandspark.operators import labels, panel, reports
from demandspark.operators.keys import restrict
from demandspark.plans import testbed as tb
from demandspark.plans.registry import query
from demandspark.schemas import INFO_FEED, STATUS_FEED
from demandspark.session import scratch
from demandspark.sources import feeds, tables, trips
from demandspark.sources import weather as wx


@query(
    "AGG-01 FLT-04 SCL-03",
    "SELECT CAST(user_id AS VARCHAR) AS station_short_name, date_trunc('hour', ts) AS hour_ts, count(*) AS departures FROM events GROUP BY 1, 2",
)
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return tb.hourly(spark, d)


@query(
    "AGG-02 SET-04",
    tb.with_(tb.HOURLY) + "SELECT * FROM hourly",
)
def monthly_partial_final(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.load(spark, d, "events").select(
        F.col("user_id").cast("string").alias("station_short_name"), F.col("ts").alias("start_time"), "event_type"
    )
    kinds = ["click", "view"]
    parts = [rows.where(F.col("event_type").isin(kinds)), rows.where(~F.col("event_type").isin(kinds))]
    return labels.merge_hourly([labels.hourly_counts(p) for p in parts])


@query(
    "SRC-01 SCL-02 FLT-04",
    tb.with_(tb.HOURLY) + "SELECT * FROM hourly",
)
def trip_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """All events as CSV under three generations of headers (by event type), next to files with an unknown header."""
    rows = tb.load(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("u"), "ts")
    iso, us = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.date_format("ts", "M/d/yyyy H:mm:ss")
    layouts = [
        (iso.alias("started_at"), F.concat(F.lit(" "), "u").alias("start_station_id"), F.lit("40.7").alias("start_lat")),
        (F.lit("x").alias("bikeid"), us.alias("Start Time"), F.concat("u", F.lit(" ")).alias("Start Station ID")),
        (F.col("u").alias("from_station_id"), iso.alias("starttime"), F.lit("a, b").alias("from_station_name")),
    ]
    kinds = [F.col("event_type") == "click", F.col("event_type") == "view", ~F.col("event_type").isin("click", "view")]
    base = scratch(spark, "trips")
    for i, (kind, layout) in enumerate(zip(kinds, layouts, strict=True)):
        rows.where(kind).select(*layout).write.option("header", True).csv(f"{base}/g{i}")
    rows.select(iso.alias("when"), F.col("u").alias("where")).write.option("header", True).csv(f"{base}/unknown")
    found, _ = trips.read_trips(spark, [base])
    return labels.hourly_counts(labels.clean_trips(found))


@query(
    "SRC-01",
    "SELECT count(*) AS n_trips, count(DISTINCT user_id) AS n_stations FROM events WHERE event_type <> 'error'",
)
def trip_csv_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Files with an unknown header are rejected whole, blank stations and bad times row by row."""
    rows = tb.load(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("u"), "ts")
    base = scratch(spark, "rejects")
    good = rows.select(
        F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("not a date").alias("started_at"),
        F.col("u").alias("start_station_id"),
    )
    blank = rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.lit("  ").alias("start_station_id"))
    unknown = rows.select(F.col("u").alias("rider"), "event_id")
    for name, frame in (("good", good), ("blank", blank), ("unknown", unknown)):
        frame.write.option("header", True).csv(f"{base}/{name}")
    found, _ = trips.read_trips(spark, [base])
    return labels.clean_trips(found).agg(F.count("*").alias("n_trips"), F.count_distinct("station_short_name").alias("n_stations"))


_SHIFTED = "shifted AS (SELECT station_short_name, hour_ts + INTERVAL 15 DAY AS hour_ts, departures FROM hourly)"


@query(
    "SRC-02 SRC-03 AGG-05 JOIN-05",
    tb.with_(tb.HOURLY, _SHIFTED)
    + """, kept AS (SELECT h.* FROM shifted h JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = h.station_short_name
                   WHERE c.c_mktsegment <> 'BUILDING'),
busy AS (SELECT station_short_name FROM kept GROUP BY 1 HAVING sum(departures) >= 50)
SELECT k.* FROM kept k JOIN busy USING (station_short_name)""",
)
def months_from_cache(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts that span months, written to the monthly table; every cached month is read back."""
    path = scratch(spark, "months")
    moved = tb.hourly(spark, d).withColumn("hour_ts", F.timestamp_add("DAY", F.lit(15), "hour_ts"))
    tables.cache_month(moved, path)
    stored = tables.cached_month(spark, path)
    months = [r.month for r in stored.select("month").distinct().collect()]  # partition values
    live = tb.stations(spark, d).where("entity_id <> 'BUILDING'")
    return tables.load_hourly(stored, months, live, tb.PARAMS)


@query("AGG-02 SET-04 SRC-02", tb.with_(tb.HOURLY) + "SELECT * FROM hourly")
def parts_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Partial counts stored per file: one file comes first with errors, another twice; the sum is that of all events."""
    path = scratch(spark, "parts")
    rows = tb.load(spark, d, "events").select(
        F.col("user_id").cast("string").alias("station_short_name"), F.col("ts").alias("start_time"), F.col("event_type").alias("file")
    )

    def store(files: DataFrame) -> None:
        tables.store_parts(labels.hourly_parts(files), path)

    wrong = rows.where("file = 'click'").withColumn("start_time", F.timestamp_add("DAY", F.lit(-60), "start_time"))
    store(wrong.unionByName(rows.where("file = 'view'")))
    store(rows.where("file <> 'view'"))
    store(rows.where("file = 'view'"))
    return labels.merge_hourly([tables.stored_parts(spark, path)])


@query(
    "AGG-05",
    tb.with_(tb.HOURLY)
    + "SELECT h.* FROM hourly h WHERE station_short_name IN (SELECT station_short_name FROM hourly GROUP BY 1 HAVING sum(departures) >= 60)",
)
def min_volume_stations(spark: SparkSession, d: str) -> DataFrame:
    return labels.min_volume(tb.hourly(spark, d), 60)


@query(
    "JOIN-05 JOIN-06 SRC-06",
    tb.with_(tb.HOURLY)
    + "SELECT h.* FROM hourly h WHERE station_short_name IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)",
)
def live_stations_semi(spark: SparkSession, d: str) -> DataFrame:
    live = tb.load(spark, d, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).otherwise("").alias("short_name")
    )
    names = feeds.live_short_names(live).withColumnRenamed("short_name", "station_short_name")
    return restrict(tb.hourly(spark, d), names, "station_short_name")


_REQUESTS = """requests AS (
  SELECT CASE event_type WHEN 'click' THEN c_mktsegment WHEN 'view' THEN CAST(user_id AS VARCHAR)
              ELSE 'unknown-' || CAST(user_id AS VARCHAR) END AS requested_id
  FROM events JOIN customer ON c_custkey = user_id)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    segments = tb.load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    known = tb.load(spark, d, "events").select("event_type", "user_id").join(segments, "user_id")
    return known.select(
        F.when(kind == "click", F.col("c_mktsegment")).when(kind == "view", user).otherwise(F.concat(F.lit("unknown-"), user)).alias("requested_id")
    )


@query(
    "FLT-15 SET-07",
    tb.with_(tb.SMAP, _REQUESTS)
    + """SELECT DISTINCT entity_id FROM smap JOIN requests ON requested_id = entity_id
UNION SELECT entity_id FROM smap JOIN requests ON requested_id = station_short_name""",
)
def request_resolution(spark: SparkSession, d: str) -> DataFrame:
    return ent.resolve_requests(_requests(spark, d), tb.station_entity(spark, d))[0]


@query(
    "SET-06 FLT-15",
    tb.with_(tb.SMAP, _REQUESTS)
    + """SELECT DISTINCT requested_id FROM requests
WHERE requested_id NOT IN (SELECT entity_id FROM smap) AND requested_id NOT IN (SELECT station_short_name FROM smap)""",
)
def unknown_ids_anti(spark: SparkSession, d: str) -> DataFrame:
    return ent.resolve_requests(_requests(spark, d), tb.station_entity(spark, d))[1]


@query("JOIN-04 AGG-04", tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS) + "SELECT * FROM entity_hours")
def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tb.entity_hours(spark, d)


@query(
    "AGG-19 JOIN-04",
    tb.with_(tb.HOURLY)
    + """SELECT count(*) FILTER (WHERE c_custkey IS NULL) AS unmapped_rows, count(*) AS total_rows
FROM hourly LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 10) ON CAST(c_custkey AS VARCHAR) = station_short_name""",
)
def unmapped_rows(spark: SparkSession, d: str) -> DataFrame:
    some = tb.load(spark, d, "customer").where("c_nationkey < 10").select(
        F.col("c_custkey").cast("string").alias("station_short_name"), F.col("c_mktsegment").alias("entity_id")
    )
    return ent.unmapped_rows(tb.hourly(spark, d), some)


@query(
    "AGG-06",
    tb.with_(tb.STATIONS, tb.ENTITIES)
    + "SELECT entity_id, round(lat, 6) AS lat, round(lon, 6) AS lon, capacity, n_stations FROM entities",
)
def entity_metadata(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(tb.entities(spark, d), 6, "lat", "lon")


@query(
    "SCL-16 SCL-17",
    tb.with_(tb.STATIONS)
    + """SELECT printf('cluster_%03d', s_nationkey) AS cluster, count(*) AS n_suppliers,
round((SELECT avg(cos(radians(lat))) FROM stations), 9) AS lon_scale FROM supplier GROUP BY 1""",
)
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    scale = ent.longitude_scale(tb.stations(spark, d)).select(F.round("lon_scale", 9)).scalar()
    counted = tb.load(spark, d, "supplier").groupBy(cluster_id(F.col("s_nationkey")).alias("cluster")).agg(F.count("*").alias("n_suppliers"))
    return counted.withColumn("lon_scale", scale)


@query(
    "JOIN-02 JOIN-03 WIN-04 WIN-05 JOIN-12",
    tb.with_(tb.HOURLY, tb.dense("hourly", key="station_short_name")) + "SELECT * FROM panel",
)
def dense_panel(spark: SparkSession, d: str) -> DataFrame:
    return tb.station_panel(spark, d)


@query(
    "WIN-05 JOIN-02",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("entity_hours", extra=6))
    + "SELECT entity_id, hour_ts, departures, CAST(missing_run_length AS DOUBLE) AS missing_run_length FROM panel",
)
def dense_panel_with_future(spark: SparkSession, d: str) -> DataFrame:
    """Six hours past the newest observation come out with an unknown target."""
    last = tb.event_hours(spark, d).agg(F.max("hour_ts")).first()[0].replace(minute=0, second=0, microsecond=0)
    grid = panel.complete_panel(tb.entity_hours(spark, d), tb.PARAMS, extra_hours=[last + timedelta(hours=6)])
    return grid.withColumn("missing_run_length", F.col("missing_run_length").cast("double"))


@query(
    "WIN-04",
    tb.with_(tb.HOURLY, tb.dense("hourly", key="station_short_name"))
    + """SELECT entity_id, min(hour_ts) AS gap_start, max(hour_ts) AS gap_end, count(*) AS gap_hours
FROM panel_l WHERE missing GROUP BY entity_id, run""",
)
def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    return panel.gap_runs(tb.station_panel(spark, d))


@query(
    "WIN-08",
    """WITH h AS (SELECT DISTINCT date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS hour_ts FROM orders),
s AS (SELECT hour_ts, date_diff('hour', lag(hour_ts) OVER (ORDER BY hour_ts), hour_ts) AS gap_hours FROM h)
SELECT gap_hours, hour_ts AS gap_end FROM s WHERE gap_hours IS NOT NULL ORDER BY gap_hours DESC, hour_ts LIMIT 1""",
)
def gap_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    hour = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.to_date("o_orderdate").cast("timestamp_ntz"))
    return panel.largest_gap(tb.load(spark, d, "orders").select(hour.alias("hour_ts")))


@query(
    "AGG-13",
    tb.with_(tb.HOURLY)
    + """SELECT station_short_name, CAST(sum(departures) AS DOUBLE) AS total, round(avg(departures), 6) AS mean,
CAST(median(departures) AS DOUBLE) AS median FROM hourly GROUP BY 1""",
)
def station_profile(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(reports.station_profile(tb.hourly(spark, d)), 6, "mean")


_DESCRIBE = """SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 4) AS std,
round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median,
round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM prof"""


@query(
    "AGG-13",
    tb.with_(
        tb.HOURLY,
        "prof AS (SELECT CAST(sum(departures) AS DOUBLE) AS total, avg(departures) AS mean, CAST(median(departures) AS DOUBLE) AS median "
        "FROM hourly GROUP BY station_short_name)",
    )
    + " UNION ALL ".join(_DESCRIBE.format(c=c) for c in ("total", "mean", "median")),
)
def station_profile_summary(spark: SparkSession, d: str) -> DataFrame:
    out = reports.profile_summary(reports.station_profile(tb.hourly(spark, d)), tb.PARAMS.rank_buckets)
    return tb.rounded(tb.rounded(out, 6, "mean", "min", "p25", "median", "p75", "max"), 4, "std")


@query(
    "AGG-14",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("hourly", "st", "station_short_name"), tb.dense("entity_hours", "en"))
    + """SELECT 'station' AS level, round(avg(CASE WHEN departures = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share,
round(avg(departures), 6) AS mean_departures, count(*) AS n_rows FROM st WHERE departures IS NOT NULL
UNION ALL SELECT 'entity', round(avg(CASE WHEN departures = 0 THEN 1.0 ELSE 0.0 END), 6), round(avg(departures), 6), count(*)
FROM en WHERE departures IS NOT NULL""",
)
def zero_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of zero hours before and after the roll-up."""
    before = reports.zero_share(panel.known_target(tb.station_panel(spark, d))).withColumn("level", F.lit("station"))
    after = reports.zero_share(panel.known_target(tb.entity_panel(spark, d))).withColumn("level", F.lit("entity"))
    return tb.rounded(before.unionByName(after), 6, "zero_share", "mean_departures")


@query(
    "AGG-15",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS)
    + """SELECT CAST(isodow(hour_ts) >= 6 AS INTEGER) AS is_weekend, CAST(hour(hour_ts) AS INTEGER) AS hour,
round(avg(departures), 6) AS mean_departures, count(*) AS n_rows FROM entity_hours GROUP BY 1, 2""",
)
def hour_profile(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(reports.hour_profile(tb.entity_hours(spark, d)), 6, "mean_departures")


@query(
    "AGG-15",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS)
    + """SELECT CAST(isodow(hour_ts) - 1 AS INTEGER) AS day_of_week, round(avg(departures), 6) AS mean_departures, count(*) AS n_rows
FROM entity_hours GROUP BY 1""",
)
def weekday_profile(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(reports.weekday_profile(tb.entity_hours(spark, d)), 6, "mean_departures")


@query(
    "AGG-16 JOIN-13",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.WEATHER)
    + """, city AS (SELECT hour_ts, sum(departures) AS departures FROM entity_hours GROUP BY 1)
SELECT round(corr(departures, temperature_c), 6) AS corr_temperature, round(corr(departures, precipitation_mm), 6) AS corr_precipitation,
round(avg(departures) FILTER (WHERE precipitation_mm < 0.1), 6) AS dry_mean,
round(avg(departures) FILTER (WHERE precipitation_mm >= 1.0), 6) AS wet_mean,
round(avg(departures) FILTER (WHERE precipitation_mm >= 1.0) / avg(departures) FILTER (WHERE precipitation_mm < 0.1) - 1, 6) AS wet_change
FROM city JOIN weather USING (hour_ts)""",
)
def weather_effect(spark: SparkSession, d: str) -> DataFrame:
    city = reports.city_demand(tb.entity_hours(spark, d), tb.weather(spark, d))
    out = reports.weather_effect(city)
    return tb.rounded(out, 6, *out.columns)


@query(
    "JOIN-14 SET-05",
    tb.with_(tb.HOURLY, tb.STATIONS)
    + """, ids AS (SELECT DISTINCT station_short_name AS k FROM hourly)
SELECT 'short_name' AS key, (SELECT count(*) FROM (SELECT k FROM ids INTERSECT SELECT short_name FROM stations)) AS matched, (SELECT count(*) FROM ids) AS total
UNION ALL SELECT 'station_id', (SELECT count(*) FROM (SELECT k FROM ids INTERSECT SELECT station_id FROM stations)), (SELECT count(*) FROM ids)""",
)
def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    return reports.key_overlap(tb.hourly(spark, d), tb.stations(spark, d), ["short_name", "station_id"])


# --- feeds and weather --------------------------------------------------------------------------


@query(
    "SRC-04 FLT-01 FLT-02",
    """SELECT 'id-' || CAST(c_custkey AS VARCHAR) AS station_id,
CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS short_name, c_name AS name,
CASE WHEN c_custkey % 7 = 3 THEN 0.0 ELSE 40.25 END AS lat, CAST(-74.5 + c_nationkey * 0.25 AS DOUBLE) AS lon,
CAST(CASE c_custkey % 4 WHEN 0 THEN c_custkey % 50 WHEN 1 THEN 3 ELSE 0 END AS INTEGER) AS capacity, CAST(c_nationkey AS VARCHAR) AS region_id
FROM customer WHERE c_nationkey NOT IN (3, 7)""",
)
def station_info_feed(spark: SparkSession, d: str) -> DataFrame:
    """Customers as feed documents: quoted and missing numbers, entries without id or coordinates."""
    key = F.col("c_custkey")
    entry = F.struct(
        F.when(F.col("c_nationkey") != 3, F.concat(F.lit("id-"), key.cast("string"))).alias("station_id"),
        F.when(key % 11 != 0, F.concat(F.lit(" "), key.cast("string"), F.lit(" "))).alias("short_name"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") == 7, F.lit("north")).when(key % 7 == 3, F.lit("0.0")).otherwise("40.25").alias("lat"),
        (F.lit(-74.5) + F.col("c_nationkey") * 0.25).alias("lon"),
        F.when(key % 4 == 0, (key % 50).cast("string")).when(key % 4 == 1, F.lit("3.0")).when(key % 4 == 2, F.lit("many")).alias("capacity"),
        F.col("c_nationkey").cast("string").alias("region_id"),
    )
    docs = tb.load(spark, d, "customer").select(
        F.to_json(F.struct(F.lit(1704067200).alias("last_updated"), F.struct(F.array(entry).alias("stations")).alias("data"))).alias("doc")
    )
    return feeds.parse_station_info(docs.select(F.from_json("doc", INFO_FEED).alias("f")).select("f.*"))


@query(
    "SRC-05 FLT-03",
    """SELECT 'id-' || CAST(user_id AS VARCHAR) AS station_id, CAST(floor(value) AS INTEGER) AS num_bikes_available,
CAST(CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS INTEGER) AS num_docks_available,
CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS SMALLINT) AS is_renting,
CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS is_installed,
epoch_ms(CAST(1704067200000 + event_id * 1000 AS BIGINT)) AS snapshot_ts
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) WHERE event_type <> 'purchase'""",
)
def station_status_feed(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    flag = (
        F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "view", "Yes").when(F.col("event_type") == "error", "no").otherwise("?")
    )
    entry = F.struct(
        F.concat(F.lit("id-"), F.col("user_id").cast("string")).alias("station_id"),
        F.when(F.col("event_type") != "purchase", F.floor("value").cast("string")).otherwise("n/a").alias("num_bikes_available"),
        F.when(k % 2 == 0, k.cast("string")).alias("num_docks_available"),
        flag.alias("is_renting"),
        (k % 3 == 0).alias("is_installed"),
    )
    docs = tb.load(spark, d, "events").select(
        F.to_json(
            F.struct((F.lit(1704067200) + F.col("event_id")).alias("last_updated"), F.struct(F.array(entry).alias("stations")).alias("data"))
        ).alias("doc")
    )
    rows = feeds.parse_station_status(docs.select(F.from_json("doc", STATUS_FEED).alias("f")).select("f.*"))
    return rows.select(
        "station_id", "num_bikes_available", "num_docks_available", "is_renting", "is_installed", utc_wall(rows, "snapshot_ts").alias("snapshot_ts")
    )


def _archive_docs(spark: SparkSession, d: str) -> DataFrame:
    """One archive document per day: 24 hours in parallel arrays, with an unreadable number per day."""
    w = tb.weather(spark, d)
    hour = F.struct(
        F.date_format("hour_ts", "yyyy-MM-dd'T'HH:mm").alias("t"),
        F.when(F.hour("hour_ts") == 5, F.lit("n/a")).otherwise(F.col("temperature_c").cast("string")).alias("a"),
        F.col("precipitation_mm").cast("string").alias("b"),
        F.col("wind_speed_kmh").cast("string").alias("c"),
    )
    days = w.groupBy(F.to_date("hour_ts").alias("day")).agg(F.sort_array(F.collect_list(hour)).alias("hs"))
    names = {"time": "t", "temperature_2m": "a", "precipitation": "b", "wind_speed_10m": "c"}
    return days.select(F.struct(*[F.col("hs")[v].alias(k) for k, v in names.items()]).alias("hourly"))


def _forecast_docs(spark: SparkSession, d: str) -> DataFrame:
    """One forecast document per day, its periods in mixed units."""
    w = tb.weather(spark, d)
    n = F.col("wind_speed_kmh").cast("int")
    period = F.struct(
        F.when(F.hour("hour_ts") == 7, F.lit("soon")).otherwise(F.date_format("hour_ts", "yyyy-MM-dd'T'HH:mm:ss'-05:00'")).alias("startTime"),
        F.col("temperature_c").cast("string").alias("temperature"),
        F.when(n % 2 == 0, F.lit("F")).otherwise(F.lit("wmoUnit:degC")).alias("temperatureUnit"),
        F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(" to "), (n + 4).cast("string"), F.lit(" mph")))
        .when(n % 3 == 1, F.concat(n.cast("string"), F.lit(" km/h")))
        .otherwise("calm").alias("windSpeed"),
        F.struct(F.when(n % 5 != 0, (n * 5).cast("string")).alias("value")).alias("probabilityOfPrecipitation"),
    )
    days = w.groupBy(F.to_date("hour_ts").alias("day")).agg(F.collect_list(period).alias("periods"))
    return days.select(F.struct("periods").alias("properties"))


_ARCHIVE = """archive AS (
  SELECT hour_ts, CASE WHEN hour(hour_ts) = 5 THEN NULL ELSE temperature_c END AS temperature_c, precipitation_mm, wind_speed_kmh FROM weather)"""
_FORECAST = """forecast AS (
  SELECT hour_ts, CASE WHEN n % 2 = 0 THEN (temperature_c - 32.0) * 5.0 / 9.0 ELSE temperature_c END AS temperature_c,
         CASE WHEN n % 5 <> 0 THEN n * 5 / 100.0 ELSE 0.0 END AS precipitation_mm,
         CASE WHEN n % 3 = 0 THEN (n + 2) * 1.609344 WHEN n % 3 = 1 THEN CAST(n AS DOUBLE) END AS wind_speed_kmh
  FROM (SELECT *, CAST(wind_speed_kmh AS INTEGER) AS n FROM weather) WHERE hour(hour_ts) <> 7)"""
_W = "round(CAST({0} AS DOUBLE), 6) AS {0}"
_WCOLS = "hour_ts, " + ", ".join(_W.format(c) for c in wx.COLUMNS[1:])


@query("SRC-07", tb.with_(tb.WEATHER, _ARCHIVE) + f"SELECT {_WCOLS} FROM archive")
def weather_archive_parse(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(wx.parse_weather_archive(_archive_docs(spark, d)), 6, *wx.COLUMNS[1:])


@query("SRC-08 SCL-10 SCL-11", tb.with_(tb.WEATHER, _FORECAST) + f"SELECT {_WCOLS} FROM forecast")
def weather_forecast_parse(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(wx.parse_weather_forecast(_forecast_docs(spark, d)), 6, *wx.COLUMNS[1:])


@query(
    "SRC-10 SET-03",
    tb.with_(tb.WEATHER, _ARCHIVE, _FORECAST)
    + f"SELECT {_WCOLS} FROM (SELECT * FROM forecast UNION ALL SELECT * FROM archive WHERE hour_ts NOT IN (SELECT hour_ts FROM forecast))",
)
def weather_union(spark: SparkSession, d: str) -> DataFrame:
    """Archive, then forecast; the later source wins an hour."""
    both = [wx.parse_weather_archive(_archive_docs(spark, d)), wx.parse_weather_forecast(_forecast_docs(spark, d))]
    return tb.rounded(wx.combine_weather(both, last_wins=True), 6, *wx.COLUMNS[1:])


@query(
    "SRC-10",
    tb.with_(tb.WEATHER, _ARCHIVE) + f"SELECT {_WCOLS} FROM archive",
)
def weather_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first provider delivers nothing, so the second one is used."""
    nothing = wx.parse_weather_forecast(_forecast_docs(spark, d)).where("hour_ts < timestamp_ntz'1990-01-01'")
    return tb.rounded(wx.live_weather(nothing, wx.parse_weather_archive(_archive_docs(spark, d))), 6, *wx.COLUMNS[1:])


@query(
    "SRC-09",
    tb.with_(tb.WEATHER)
    + """SELECT w.* FROM weather w, (SELECT min(ts) AS lo, max(ts) AS hi FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-15') b
WHERE hour_ts >= date_trunc('day', lo) - INTERVAL 1 DAY AND hour_ts < date_trunc('day', hi) + INTERVAL 2 DAY""",
)
def weather_for_series(spark: SparkSession, d: str) -> DataFrame:
    series = tb.event_hours(spark, d).where("hour_ts between timestamp_ntz'2024-01-10' and timestamp_ntz'2024-01-15'")
    return wx.weather_for(series, tb.weather(spark, d))
