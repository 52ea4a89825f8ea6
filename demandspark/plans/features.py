"""Queries: features, split, sequences and forecast errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.calendar import add_calendar, add_seasonal, holiday_name
from demandspark.functions.stats import METRICS
from demandspark.functions.times import local_hour
from demandspark.operators import evaluate as ev
from demandspark.operators import panel as pn
from demandspark.operators import reports
from demandspark.params import CALENDAR_FEATURES, SEASONAL_GROUPS
from demandspark.plans import testbed as tb
from demandspark.plans.registry import query

P = tb.PARAMS
ENTITY_PANEL = (tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("entity_hours"))
_STATION_PANEL = (tb.HOURLY, tb.dense("hourly", key="station_short_name"))
_BY_ENTITY = "OVER (PARTITION BY entity_id ORDER BY hour_ts)"


def lagged_panel(spark: SparkSession, d: str) -> DataFrame:
    return pn.add_lags(tb.entity_panel(spark, d).drop("missing_run_length"), P)


LAGGED = f"lagged AS (SELECT entity_id, hour_ts, departures, {tb.lags_sql()} FROM panel)"


@query("WIN-02", tb.with_(*_STATION_PANEL) + f"SELECT entity_id, hour_ts, departures, {tb.lags_sql()} FROM panel")
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    return pn.add_lags(tb.station_panel(spark, d).drop("missing_run_length"), P)


@query("WIN-03", tb.with_(*_STATION_PANEL) + f"SELECT entity_id, hour_ts, {tb.rolling_sql()} FROM panel")
def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    out = pn.add_rolling(tb.station_panel(spark, d), P).drop("departures", "missing_run_length")
    return tb.rounded(out, 4, *P.rolling_features)


# Holidays of the years in the test tables, spelled out.
_HOLIDAYS = """holidays AS (
  WITH y AS (SELECT unnest(generate_series(1990, 2030)) AS y),
  fixed AS (SELECT make_date(y, m, dd) AS d FROM y, (VALUES (1,1),(7,4),(11,11),(12,25)) t(m, dd)
            UNION ALL SELECT make_date(y, 6, 19) FROM y WHERE y >= 2021),
  days AS (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE AS d),
  ranked AS (SELECT d, month(d) AS m, isodow(d) AS wd,
                    row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d) AS nth,
                    row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d DESC) AS from_end FROM days)
  SELECT d FROM fixed UNION SELECT d - 1 FROM fixed WHERE isodow(d) = 6 UNION SELECT d + 1 FROM fixed WHERE isodow(d) = 7
  UNION SELECT d FROM ranked WHERE wd = 1 AND ((m = 1 AND nth = 3) OR (m = 2 AND nth = 3) OR (m = 9 AND nth = 1) OR (m = 10 AND nth = 2))
  UNION SELECT d FROM ranked WHERE wd = 1 AND m = 5 AND from_end = 1
  UNION SELECT d FROM ranked WHERE wd = 4 AND m = 11 AND nth = 4)"""


def _calendar_sql(ts: str) -> str:
    return f"""CAST(hour({ts}) AS INTEGER) AS hour, CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week,
CAST(isodow({ts}) >= 6 AS INTEGER) AS is_weekend, CAST(CAST({ts} AS DATE) IN (SELECT d FROM holidays) AS INTEGER) AS is_holiday,
CAST(month({ts}) AS INTEGER) AS month,
CAST(CASE WHEN month({ts}) IN (12, 1, 2) THEN 0 WHEN month({ts}) <= 5 THEN 1 WHEN month({ts}) <= 8 THEN 2 ELSE 3 END AS INTEGER) AS season,
round(sin(2 * pi() * hour({ts}) / 24), 4) + 0.0 AS hour_sin, round(cos(2 * pi() * hour({ts}) / 24), 4) + 0.0 AS hour_cos,
round(sin(2 * pi() * (isodow({ts}) - 1) / 7), 4) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow({ts}) - 1) / 7), 4) + 0.0 AS dow_cos"""


_WAVES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")


@query(
    "SCL-05 SCL-06 SCL-07",
    tb.with_(_HOLIDAYS) + f"SELECT o_orderkey, {_calendar_sql('t')} FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t FROM orders)",
)
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    hour = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate"))
    rows = tb.load(spark, d, "orders").select("o_orderkey", hour.alias("hour_ts"))
    return tb.rounded(add_calendar(rows, P), 4, *_WAVES).select("o_orderkey", *CALENDAR_FEATURES)


@query(
    "SCL-06",
    tb.with_(_HOLIDAYS)
    + "SELECT CAST(o_orderdate AS DATE)::TIMESTAMP AS day, count(*) AS n_orders FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT d FROM holidays) GROUP BY 1",
)
def holiday_orders(spark: SparkSession, d: str) -> DataFrame:
    days = tb.load(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"))
    return days.where(holiday_name(F.col("day")).isNotNull()).withColumn("day", F.col("day").cast("timestamp_ntz"))


_TZ = "America/New_York"
_SOLAR = f"""geo AS (
  SELECT o_orderkey, t, dayofyear(t) AS doy, hour(t) + 0.5::DOUBLE AS mid, radians(40.7306::DOUBLE) AS lat,
         radians(23.44::DOUBLE) * sin(2 * pi() * (dayofyear(t) - 81) / 365.0::DOUBLE) AS decl,
         epoch(r - ((r AT TIME ZONE '{_TZ}') AT TIME ZONE 'UTC')) / 3600.0::DOUBLE AS off
  FROM (SELECT *, CASE WHEN ((t AT TIME ZONE '{_TZ}') AT TIME ZONE 'UTC') AT TIME ZONE 'UTC' AT TIME ZONE '{_TZ}' = t THEN t
          ELSE t + INTERVAL 1 HOUR END AS r  -- a skipped reading has the offset of the hour after it
        FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t FROM orders))),
sun AS (
  SELECT *, 2 * degrees(acos(greatest(-1, least(1, (sin(radians(-0.833::DOUBLE)) - sin(lat) * sin(decl)) / (cos(lat) * cos(decl)))))) / 15 AS dl,
         12 + 73.9866::DOUBLE / 15 + off AS noon FROM geo)"""


@query(
    "SCL-07 SCL-08 SCL-09",
    tb.with_(_SOLAR)
    + """SELECT o_orderkey, round(sin(2 * pi() * doy / 365.25), 4) + 0.0 AS day_of_year_sin, round(cos(2 * pi() * doy / 365.25), 4) + 0.0 AS day_of_year_cos,
CAST(weekofyear(t) AS INTEGER) AS week_of_year, round(dl, 4) AS daylight_hours,
CAST(mid >= noon - dl / 2 AND mid <= noon + dl / 2 AS INTEGER) AS is_daylight, round(abs(mid - noon), 4) AS hours_from_solar_noon FROM sun""",
)
def solar_features(spark: SparkSession, d: str) -> DataFrame:
    """Every order hour, those that a spring clock change skips included."""
    hour = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate"))
    rows = tb.load(spark, d, "orders").select("o_orderkey", hour.alias("hour_ts"))
    out = add_seasonal(rows, P.but(timezone=_TZ))
    names = [n for g in SEASONAL_GROUPS.values() for n in g]
    return tb.rounded(out, 4, "day_of_year_sin", "day_of_year_cos", "daylight_hours", "hours_from_solar_noon").select("o_orderkey", *names)


@query(
    "SCL-04",
    f"""SELECT date_trunc('hour', (ts AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}') AS hour_ts, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT date_trunc('hour', (t AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}'), count(*)
FROM (SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t FROM orders) GROUP BY 1""",
)
def local_hour_buckets(spark: SparkSession, d: str) -> DataFrame:
    """UTC times of several years in local hours, across every clock change."""


    order_time = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate"))
    events = tb.load(spark, d, "events").groupBy(local_hour(F.col("ts"), _TZ).alias("hour_ts")).agg(F.count("*").alias("n"))
    orders = tb.load(spark, d, "orders").groupBy(local_hour(order_time, _TZ).alias("hour_ts")).agg(F.count("*").alias("n"))
    return events.unionByName(orders)


def _full_panel(spark: SparkSession, d: str) -> DataFrame:
    return pn.feature_panel(tb.entity_hours(spark, d), tb.entities(spark, d), tb.weather(spark, d), P, bounds=tb.event_hours(spark, d))


_PANEL_ROUND = {**dict.fromkeys(_WAVES, 4), **dict.fromkeys(P.rolling_features, 4), "lat": 6, "lon": 6}


def _as_double(sql: str) -> str:
    return sql.replace("AS INTEGER)", "AS DOUBLE)")


@query(
    "ML-03 JOIN-07 JOIN-08 FLT-18 WIN-02 WIN-03 WIN-09",
    tb.with_(*ENTITY_PANEL, tb.STATIONS, tb.ENTITIES, tb.WEATHER, _HOLIDAYS)
    + f"""SELECT p.entity_id, p.hour_ts, p.departures, {_as_double(_calendar_sql('p.hour_ts'))}, {", ".join("p." + c for c in P.lag_features + P.rolling_features)},
e.capacity, CAST(e.n_stations AS DOUBLE) AS n_stations, round(e.lat, 6) AS lat, round(e.lon, 6) AS lon, w.temperature_c, w.precipitation_mm, w.wind_speed_kmh
FROM (SELECT entity_id, hour_ts, departures, {tb.lags_sql()}, {tb.rolling_sql()} FROM panel) p
LEFT JOIN entities e USING (entity_id) LEFT JOIN weather w USING (hour_ts)""",
)
def feature_panel(spark: SparkSession, d: str) -> DataFrame:
    four = [n for n, digits in _PANEL_ROUND.items() if digits == 4]
    return tb.rounded(tb.rounded(_full_panel(spark, d), 4, *four), 6, "lat", "lon")


@query(
    "FLT-13 WIN-12 FLT-14 ML-04",
    tb.with_(*ENTITY_PANEL, LAGGED)
    + """, warm AS (SELECT * FROM lagged WHERE hour_ts >= (SELECT min(hour_ts) + INTERVAL 168 HOUR FROM lagged) AND departures IS NOT NULL)
SELECT entity_id, hour_ts, departures, lag_168h, CASE WHEN hour_ts >= m - INTERVAL 336 HOUR THEN 'test' WHEN hour_ts >= m - INTERVAL 504 HOUR THEN 'validation' ELSE 'train' END AS split
FROM warm, (SELECT max(hour_ts) AS m FROM warm)""",
)
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return ev.chronological_split(pn.known_target(pn.drop_warmup(lagged_panel(spark, d), P)), P).select(
        "entity_id", "hour_ts", "departures", "lag_168h", "split"
    )


SPLIT = """warm AS (SELECT * FROM lagged WHERE hour_ts >= (SELECT min(hour_ts) + INTERVAL 168 HOUR FROM lagged) AND departures IS NOT NULL),
split AS (SELECT warm.*, CASE WHEN hour_ts >= m - INTERVAL 336 HOUR THEN 'test' WHEN hour_ts >= m - INTERVAL 504 HOUR THEN 'validation' ELSE 'train' END AS split
FROM warm, (SELECT max(hour_ts) AS m FROM warm))"""


def split_panel(spark: SparkSession, d: str) -> DataFrame:
    hours = tb.event_hours(spark, d)
    return ev.chronological_split(pn.known_target(pn.drop_warmup(lagged_panel(spark, d), P, hours)), P, hours)


@query(
    "FLT-13",
    tb.with_(*_STATION_PANEL)
    + "SELECT entity_id, hour_ts, departures FROM panel WHERE hour_ts >= (SELECT min(hour_ts) + INTERVAL 168 HOUR FROM panel)",
)
def warmup_drop(spark: SparkSession, d: str) -> DataFrame:
    return pn.drop_warmup(tb.station_panel(spark, d).drop("missing_run_length"), P)


@query(
    "FLT-12 FLT-14",
    tb.with_(*_STATION_PANEL)
    + "SELECT entity_id, hour_ts, departures FROM panel WHERE departures IS NOT NULL AND hour_ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-19 21:00:00'",
)
def training_window(spark: SparkSession, d: str) -> DataFrame:
    rows = pn.known_target(tb.station_panel(spark, d).drop("missing_run_length"))
    return pn.between_hours(rows, "2024-01-05 03:00:00", "2024-01-19 21:00:00")


@query(
    "AGG-10",
    tb.with_(*ENTITY_PANEL, LAGGED, SPLIT)
    + "SELECT split, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, min(hour_ts) AS first_hour, max(hour_ts) AS last_hour FROM split GROUP BY 1",
)
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.dataset_summary(split_panel(spark, d))


_B = "baseline_"


@query(
    "AGG-07 AGG-08",
    tb.with_(*ENTITY_PANEL, LAGGED)
    + f"SELECT {tb.metrics_sql('departures', 'lag_168h', prefix=_B)} FROM lagged WHERE departures IS NOT NULL AND lag_168h IS NOT NULL",
)
def naive_baseline_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(ev.naive_baseline(lagged_panel(spark, d)), 6, *[_B + m for m in METRICS])


@query(
    "AGG-07 AGG-08 ML-07",
    tb.with_(*ENTITY_PANEL, LAGGED, SPLIT)
    + f"SELECT split, {tb.metrics_sql('departures', 'lag_24h')} FROM split WHERE lag_24h IS NOT NULL GROUP BY 1",
)
def metrics_by_split(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(ev.regression_metrics(split_panel(spark, d), "departures", "lag_24h", ["split"]), 6, *METRICS)


@query(
    "AGG-07 AGG-08",
    tb.with_(*_STATION_PANEL)
    + f""", lagged AS (SELECT *, lag(departures, 168) {_BY_ENTITY} AS lag_168h FROM panel)
SELECT entity_id, {tb.metrics_sql('departures', 'lag_168h', prefix=_B)} FROM lagged WHERE departures IS NOT NULL AND lag_168h IS NOT NULL GROUP BY 1""",
)
def naive_baseline_by_station(spark: SparkSession, d: str) -> DataFrame:
    lagged = pn.add_lags(tb.station_panel(spark, d), P)
    return tb.rounded(ev.naive_baseline(lagged, ["entity_id"]), 6, *[_B + m for m in METRICS])


@query(
    "AGG-20",
    tb.with_(*ENTITY_PANEL, LAGGED, SPLIT)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END, 4) AS std, "
        f"round(greatest(avg(departures), 1), 6) AS target_scale FROM split WHERE split = 'train'"
        for c in ("lag_1h", "lag_24h", "lag_168h")
    ),
)
def standardise_stats(spark: SparkSession, d: str) -> DataFrame:
    train = split_panel(spark, d).where("split = 'train'")
    scale = ev.target_scale(train).scalar()
    out = ev.standardise_stats(train, ["lag_1h", "lag_24h", "lag_168h"]).withColumn("target_scale", scale)
    return tb.rounded(tb.rounded(out, 6, "mean", "target_scale"), 4, "std")


@query(
    "JOIN-11 AGG-21",
    tb.with_(*ENTITY_PANEL, LAGGED, SPLIT)
    + """SELECT split, round(avg(CASE WHEN lag_24h >= 1 AND hour(hour_ts) >= 6 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n_rows FROM split GROUP BY 1""",
)
def prediction_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Predictions exist for daytime hours with recent demand only; the rest of the split stays, unpredicted."""
    split = split_panel(spark, d)
    some = split.where((F.col("lag_24h") >= 1) & (F.hour("hour_ts") >= 6)).select("entity_id", "hour_ts", F.col("lag_24h").alias("predicted"))
    return tb.rounded(ev.coverage(ev.align_predictions(split, some), by=["split"]), 6, "coverage")


_SEQ = P.sequence_length


@query(
    "WIN-10",
    tb.with_(*ENTITY_PANEL)
    + f""", s AS (SELECT entity_id, hour_ts, departures, list(departures) FILTER (WHERE departures IS NOT NULL) OVER w AS seq
FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY hour_ts ROWS BETWEEN {_SEQ} PRECEDING AND 1 PRECEDING))
SELECT entity_id, hour_ts, md5(array_to_string(list_transform(seq, lambda x: CAST(x AS BIGINT)), ',')) AS seq_hash, CAST(len(seq) AS INTEGER) AS seq_len, departures AS target
FROM s WHERE len(seq) = {_SEQ} AND departures IS NOT NULL""",
)
def sequences(spark: SparkSession, d: str) -> DataFrame:
    seq = pn.sequences(tb.entity_panel(spark, d), _SEQ)
    text = F.array_join(F.transform("sequence", lambda x: x.cast("bigint").cast("string")), ",")
    return seq.select("entity_id", "hour_ts", F.md5(text).alias("seq_hash"), F.size("sequence").alias("seq_len"), "target")


@query(
    "WIN-06 WIN-11",
    tb.with_(*ENTITY_PANEL, LAGGED, SPLIT)
    + f"""SELECT entity_id, hour_ts, departures, split = 'test' AS is_split_row FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, split ORDER BY hour_ts DESC) AS rn FROM split WHERE split IN ('validation', 'test'))
WHERE split = 'test' OR rn <= {_SEQ}""",
)
def context_split(spark: SparkSession, d: str) -> DataFrame:
    """The test rows, prefixed by the last validation rows of each entity as context."""
    split = split_panel(spark, d).select("entity_id", "hour_ts", "departures", "split")
    return pn.with_context(split.where("split = 'test'").drop("split"), split.where("split = 'validation'").drop("split"), _SEQ)


@query(
    "WIN-10 WIN-11",
    tb.with_(*ENTITY_PANEL, LAGGED, SPLIT)
    + f""", ctx AS (SELECT entity_id, hour_ts, departures, split FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, split ORDER BY hour_ts DESC) AS rn FROM split WHERE split IN ('validation', 'test'))
WHERE split = 'test' OR rn <= {_SEQ}),
s AS (SELECT *, list(departures) OVER (PARTITION BY entity_id ORDER BY hour_ts ROWS BETWEEN {_SEQ} PRECEDING AND 1 PRECEDING) AS seq FROM ctx)
SELECT entity_id, count(*) AS n_sequences, CAST(sum(departures) AS DOUBLE) AS target_sum, CAST(sum(list_sum(seq)) AS DOUBLE) AS seq_sum FROM s
WHERE split = 'test' AND len(seq) = {_SEQ} GROUP BY 1""",
)
def context_sequences(spark: SparkSession, d: str) -> DataFrame:
    split = split_panel(spark, d).select("entity_id", "hour_ts", "departures", "split")
    rows = pn.with_context(split.where("split = 'test'").drop("split"), split.where("split = 'validation'").drop("split"), _SEQ)
    seq = pn.sequences(rows, _SEQ, target_flag="is_split_row")
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    return seq.groupBy("entity_id").agg(F.count("*").alias("n_sequences"), F.sum("target").alias("target_sum"), F.sum(total).alias("seq_sum"))


# --- predictions against what happened ----------------------------------------------------------

_MATCHED = (*ENTITY_PANEL, tb.PREDICTIONS)


def matched(spark: SparkSession, d: str) -> DataFrame:
    return ev.match_predictions(tb.predictions(spark, d), tb.hourly(spark, d), tb.station_entity(spark, d))


@query(
    "JOIN-09 WIN-07",
    tb.with_(*_MATCHED) + "SELECT entity_id, target_hour_ts, predicted, actual, model_version FROM matched",
)
def predictions_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).select("entity_id", "target_hour_ts", "predicted", "actual", "model_version")


@query(
    "TOP-02 SCL-20",
    tb.with_(*_MATCHED)
    + """SELECT entity_id, target_hour_ts, predicted, actual, predicted - actual AS error, abs(predicted - actual) AS abs_error,
CASE WHEN predicted > actual THEN 'over' WHEN predicted < actual THEN 'under' ELSE 'exact' END AS direction
FROM matched WHERE target_hour_ts = (SELECT max(target_hour_ts) FROM matched) ORDER BY abs_error DESC, entity_id LIMIT 15""",
)
def top_errors(spark: SparkSession, d: str) -> DataFrame:
    return ev.top_errors(matched(spark, d)).select("entity_id", "target_hour_ts", "predicted", "actual", "error", "abs_error", "direction")


@query(
    "AGG-12",
    tb.with_(*_MATCHED) + "SELECT target_hour_ts, sum(predicted) AS predicted, sum(actual) AS actual FROM matched GROUP BY 1",
)
def demand_over_time(spark: SparkSession, d: str) -> DataFrame:
    return ev.demand_over_time(matched(spark, d))


@query(
    "AGG-17",
    tb.with_(*_MATCHED)
    + """SELECT CAST(hour(target_hour_ts) AS INTEGER) AS hour, round(avg(abs(predicted - actual)), 6) AS mae, round(avg(actual), 6) AS mean_actual, count(*) AS n
FROM matched GROUP BY 1""",
)
def error_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(ev.error_profile(matched(spark, d), {"hour": F.hour("target_hour_ts")}), 6, "mae", "mean_actual")


@query(
    "AGG-17",
    tb.with_(*_MATCHED)
    + """SELECT entity_id, round(avg(abs(predicted - actual)), 6) AS mae, round(avg(actual), 6) AS mean_actual, count(*) AS n,
round(avg(abs(predicted - actual)) / avg(actual), 6) AS relative_error FROM matched GROUP BY 1""",
)
def error_by_entity(spark: SparkSession, d: str) -> DataFrame:
    by_entity = ev.relative_error(ev.error_profile(matched(spark, d), {"entity_id": F.col("entity_id")}))
    return tb.rounded(by_entity, 6, "mae", "mean_actual", "relative_error")


@query(
    "AGG-17",
    tb.with_(*_MATCHED)
    + """, prof AS (SELECT avg(abs(predicted - actual)) / avg(actual) AS r FROM matched GROUP BY entity_id)
SELECT 'relative_error' AS feature, count(r) AS count, round(avg(r), 6) AS mean, round(stddev_samp(r), 4) AS std, round(min(r), 6) AS min,
round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75), 6) AS p75, round(max(r), 6) AS max FROM prof""",
)
def relative_error_summary(spark: SparkSession, d: str) -> DataFrame:
    by_entity = ev.relative_error(ev.error_profile(matched(spark, d), {"entity_id": F.col("entity_id")}))
    out = reports.relative_error_summary(by_entity, P.rank_buckets)
    return tb.rounded(tb.rounded(out, 6, "mean", "min", "p25", "median", "p75", "max"), 4, "std")


@query(
    "JOIN-10 MON-11",
    tb.with_(*_MATCHED, tb.STATIONS, tb.ENTITIES)
    + """SELECT entity_id, target_hour_ts, predicted, actual, predicted - actual AS error, round(lat, 6) AS lat, round(lon, 6) AS lon, n_stations
FROM matched LEFT JOIN entities USING (entity_id)""",
)
def comparison(spark: SparkSession, d: str) -> DataFrame:
    out = ev.comparison(matched(spark, d), tb.entities(spark, d))
    return tb.rounded(out, 6, "lat", "lon").select("entity_id", "target_hour_ts", "predicted", "actual", "error", "lat", "lon", "n_stations")


@query(
    "TOP-01",
    tb.with_(*ENTITY_PANEL, LAGGED)
    + "SELECT entity_id, hour_ts, departures, lag_1h FROM lagged ORDER BY entity_id, hour_ts",
)
def ordered_panel(spark: SparkSession, d: str) -> DataFrame:
    return pn.ordered(lagged_panel(spark, d).select("entity_id", "hour_ts", "departures", "lag_1h"))


