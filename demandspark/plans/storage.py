"""Queries: reads, windows of history, upserts, retention, packed features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.times import age_hours, ntz
from demandspark.operators import evaluate as ev
from demandspark.operators import labels as lb
from demandspark.operators import panel as pn
from demandspark.operators import reports, score
from demandspark.operators.keys import first_per_key, latest_per_key
from demandspark.params import PROXY_LABEL, TRUE_LABEL
from demandspark.plans import testbed as tb
from demandspark.plans.registry import query
from demandspark.session import scratch
from demandspark.sinks import tables as sk
from demandspark.sources import tables as tbl

P = tb.PARAMS
_CUT = "2024-01-16 00:00:00"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored hourly table: true counts of the first half of the month, with interval counts."""
    rows = tb.hourly(spark, d).where(F.col("hour_ts") < ntz(_CUT))
    return rows.select(
        "station_short_name", "hour_ts", F.col("departures").cast("double").alias("departures"),
        F.lit(TRUE_LABEL).alias("label_source"), F.lit(60).cast("int").alias("n_intervals"),
    )


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """A batch overlapping the stored hours, each key three times with rising values."""
    rows = tb.hourly(spark, d).where(F.col("hour_ts") >= ntz("2024-01-10 00:00:00"))
    return rows.select(
        "station_short_name", "hour_ts", F.lit(TRUE_LABEL).alias("label_source"),
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"), "departures",
    ).withColumn("departures", F.col("departures") * 10.0 + F.col("seq"))


_STORED = f"""stored AS (SELECT station_short_name, hour_ts, CAST(departures AS DOUBLE) AS departures, '{TRUE_LABEL}' AS label_source, 60.0::DOUBLE AS n_intervals
  FROM hourly WHERE hour_ts < TIMESTAMP '{_CUT}')"""
_INCOMING = f"""incoming AS (SELECT station_short_name, hour_ts, '{TRUE_LABEL}' AS label_source, departures * 10.0::DOUBLE + 3 AS departures
  FROM hourly WHERE hour_ts >= TIMESTAMP '2024-01-10 00:00:00')"""


def _doubled(df: DataFrame) -> DataFrame:
    return df.withColumn("n_intervals", F.col("n_intervals").cast("double"))


@query(
    "SNK-01 SNK-04",
    tb.with_(tb.HOURLY, _STORED, _INCOMING)
    + """SELECT coalesce(s.station_short_name, i.station_short_name) AS station_short_name, coalesce(s.hour_ts, i.hour_ts) AS hour_ts,
coalesce(i.departures, s.departures) AS departures, coalesce(i.label_source, s.label_source) AS label_source, s.n_intervals AS n_intervals
FROM stored s FULL OUTER JOIN incoming i ON s.station_short_name = i.station_short_name AND s.hour_ts = i.hour_ts AND s.label_source = i.label_source""",
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Matched keys take the batch's last value, columns the batch lacks keep theirs."""
    keys = ["station_short_name", "hour_ts", "label_source"]
    return _doubled(sk.upsert(_stored(spark, d), _incoming(spark, d), keys, order=["seq"]))


@query(
    "SNK-01 SNK-03 SNK-04",
    tb.with_(tb.HOURLY, _STORED, _INCOMING)
    + """SELECT coalesce(s.station_short_name, i.station_short_name) AS station_short_name, coalesce(s.hour_ts, i.hour_ts) AS hour_ts,
coalesce(i.departures, s.departures) AS departures, coalesce(i.label_source, s.label_source) AS label_source, s.n_intervals AS n_intervals
FROM stored s FULL OUTER JOIN incoming i ON s.station_short_name = i.station_short_name AND s.hour_ts = i.hour_ts AND s.label_source = i.label_source""",
)
def upsert_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same merge into a table stored by label and day: created by a first batch, then merged twice, where only the
    days of the batch are read and written."""
    path = scratch(spark, "stored-hourly")
    keys, by = ["station_short_name", "hour_ts", "label_source", "day"], ["label_source", "day"]
    day = F.to_date("hour_ts")
    sk.upsert_table(spark, path, _stored(spark, d).withColumn("day", day), keys, by)
    for _ in range(2):
        sk.upsert_table(spark, path, _incoming(spark, d).withColumn("day", day), keys, by, order=["seq"])
    names = ["station_short_name", "hour_ts", "departures", "label_source", "n_intervals"]
    return _doubled(spark.read.parquet(path).select(names))


@query(
    "SNK-01",
    tb.with_(tb.HOURLY, _STORED, _INCOMING)
    + """SELECT * FROM stored UNION ALL SELECT i.station_short_name, i.hour_ts, i.departures, i.label_source, NULL FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.station_short_name = i.station_short_name AND s.hour_ts = i.hour_ts)""",
)
def upsert_keep_existing(spark: SparkSession, d: str) -> DataFrame:
    keys = ["station_short_name", "hour_ts", "label_source"]
    return _doubled(sk.upsert(_stored(spark, d), _incoming(spark, d), keys, update=False, order=["seq"]))


def _two_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = tb.load(spark, d, "events").select(F.col("user_id").cast("string").alias("station_short_name"), F.col("ts").alias("start_time"), "event_type")
    true = lb.hourly_counts(events.where(F.col("event_type").isin("click", "view")))
    proxy = lb.hourly_counts(events.where(~F.col("event_type").isin("click", "signup")))
    return true.withColumn("departures", F.col("departures").cast("double")), proxy.withColumn("departures", F.col("departures") + F.lit(0.5))


_LABELLED = f"""labelled AS (
  SELECT CAST(user_id AS VARCHAR) AS station_short_name, date_trunc('hour', ts) AS hour_ts, CAST(count(*) AS DOUBLE) AS departures, '{TRUE_LABEL}' AS label_source
  FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2
  UNION ALL SELECT CAST(user_id AS VARCHAR), date_trunc('hour', ts), count(*) + 0.5::DOUBLE, '{PROXY_LABEL}'
  FROM events WHERE event_type NOT IN ('click', 'signup') GROUP BY 1, 2)"""
_RESOLVED = f"""resolved AS (SELECT * FROM labelled
  QUALIFY row_number() OVER (PARTITION BY station_short_name, hour_ts ORDER BY CASE label_source WHEN '{TRUE_LABEL}' THEN 0 ELSE 1 END) = 1)"""


@query("SET-01 SNK-04 FLT-17", tb.with_(_LABELLED, _RESOLVED) + "SELECT * FROM resolved")
def label_precedence(spark: SparkSession, d: str) -> DataFrame:
    true, proxy = _two_labels(spark, d)
    return lb.select_labels(true, proxy, "blend")


@query(
    "SRC-13 FLT-17",
    tb.with_(_LABELLED, _RESOLVED)
    + f"""SELECT 'all' AS labels, station_short_name, hour_ts, departures FROM resolved WHERE hour_ts >= TIMESTAMP '{_CUT}'
UNION ALL SELECT 'proxy', station_short_name, hour_ts, departures FROM labelled WHERE label_source = '{PROXY_LABEL}' AND hour_ts >= TIMESTAMP '{_CUT}'""",
)
def window_since(spark: SparkSession, d: str) -> DataFrame:
    """Both labels stored: an hour with two of them is counted once."""
    true, proxy = _two_labels(spark, d)
    both = lb.with_label(true, TRUE_LABEL).unionByName(lb.with_label(proxy, PROXY_LABEL))
    every = tbl.window_since(both, _CUT).withColumn("labels", F.lit("all"))
    only = tbl.window_since(both, _CUT, PROXY_LABEL).withColumn("labels", F.lit("proxy"))
    return every.unionByName(only)


@query(
    "SRC-12 JOIN-12",
    tb.with_(tb.HOURLY)
    + "SELECT station_short_name, hour_ts, CAST(departures AS DOUBLE) AS departures FROM hourly WHERE hour_ts >= (SELECT max(hour_ts) - INTERVAL 72 HOUR FROM hourly)",
)
def latest_window(spark: SparkSession, d: str) -> DataFrame:
    return tbl.latest_window(tb.hourly(spark, d), 72)


@query(
    "SRC-18",
    tb.with_(tb.HOURLY)
    + f"""SELECT h.station_short_name, h.hour_ts, CAST(h.departures AS DOUBLE) AS departures, b.m AS latest_hour, c.source
FROM hourly h, (SELECT max(hour_ts) AS m FROM hourly) b, (VALUES (0, 'stale'), (1, 'fresh'), (2, 'fallback')) c(i, source)
WHERE h.hour_ts >= b.m - INTERVAL {P.history_hours} HOUR""",
)
def history_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The same history asked for late, in time, and with an empty primary table."""
    hourly = tb.hourly(spark, d)
    nothing = hourly.where("hour_ts < timestamp_ntz'1990-01-01'")
    late = tbl.recent_history(hourly, None, "2024-02-20 00:00:00", P)
    timely = tbl.recent_history(hourly, None, "2024-01-31 01:00:00", P)
    return late.unionByName(timely).unionByName(tbl.recent_history(nothing, hourly, tb.NOW, P))


@query(
    "SRC-18 MON-13",
    tb.with_(tb.HOURLY) + "SELECT 'stale' AS source, max(hour_ts) AS latest_hour FROM hourly UNION ALL SELECT 'none', NULL",
)
def history_source(spark: SparkSession, d: str) -> DataFrame:
    hourly = tb.hourly(spark, d)
    nothing = hourly.where("hour_ts < timestamp_ntz'1990-01-01'")
    some = tbl.history_source(tbl.recent_history(hourly, None, "2024-02-20 00:00:00", P))
    return some.unionByName(tbl.history_source(tbl.recent_history(nothing, None, tb.NOW, P)))


@query(
    "SRC-11 SNK-02 SNK-01",
    tb.with_(tb.STATIONS)
    + "SELECT station_id, short_name, lat, lon, CASE WHEN region_id = '3' THEN 99 ELSE capacity END AS capacity FROM stations",
)
def station_info_table(spark: SparkSession, d: str) -> DataFrame:
    """Metadata stored, some stations updated, read back with a projection."""
    path = scratch(spark, "info")
    info = tb.info(spark, d).withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    changed = info.where("region_id = '3'").select("station_id", F.lit(99).alias("capacity"))
    sk.write_table(sk.upsert(info, changed, ["station_id"]), path, sort=["station_id"])
    return tbl.table(spark, path, "station_info", ["station_id", "short_name", "lat", "lon", "capacity"])


@query(
    "SNK-04 SRC-13",
    tb.with_(_LABELLED) + f"SELECT station_short_name, hour_ts, departures FROM labelled WHERE label_source = '{PROXY_LABEL}' AND hour_ts >= TIMESTAMP '{_CUT}'",
)
def hourly_table_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The hourly table partitioned by label: one label is read by partition pruning, the hour range by statistics."""
    path = scratch(spark, "hourly")
    true, proxy = _two_labels(spark, d)
    both = lb.with_label(true, TRUE_LABEL).unionByName(lb.with_label(proxy, PROXY_LABEL))
    sk.write_table(both, path, ["label_source"], ["hour_ts", "station_short_name"])
    stored = tbl.table(spark, path, "hourly_departures", ["station_short_name", "hour_ts", "departures", "label_source"], "hour_ts", start=_CUT)
    return stored.where(F.col("label_source") == PROXY_LABEL).drop("label_source")


@query(
    "SNK-05 SRC-15",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("entity_hours"), tb.PREDICTIONS)
    + f"SELECT entity_id, target_hour_ts, predicted, model_version FROM predictions WHERE target_hour_ts >= TIMESTAMP '{_CUT}' AND target_hour_ts < TIMESTAMP '2024-01-20'",
)
def prediction_log_range(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of predictions appended to a log stored by day, a half-open range read: other days are not opened."""
    path = scratch(spark, "predictions")
    log = tb.predictions(spark, d).withColumns({"model_name": F.lit("naive"), "predicted_at": F.col("predicted_at").cast("timestamp")})
    for version in ("v1", "v2"):
        sk.append(log.where(F.col("model_version") == version), path, "target_hour_ts")
    return tbl.table(
        spark, path, "predictions", ["entity_id", "target_hour_ts", "predicted", "model_version"], "target_hour_ts", _CUT, "2024-01-20 00:00:00", day=True
    )


@query(
    "SRC-14",
    tb.with_(tb.SNAPSHOTS) + "SELECT * FROM snapshots WHERE snapshot_ts >= TIMESTAMP '2024-01-29 09:30:00' ORDER BY station_id, snapshot_ts",
)
def recent_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return tbl.recent_snapshots(tb.snapshots(spark, d), "2024-01-29 09:30:00")


@query(
    "SNK-08",
    tb.with_(tb.SNAPSHOTS)
    + f"SELECT station_id, snapshot_ts, num_bikes_available FROM snapshots WHERE snapshot_ts >= TIMESTAMP '{tb.NOW}' - INTERVAL 72 HOUR",
)
def retention(spark: SparkSession, d: str) -> DataFrame:
    kept = sk.retain(tb.snapshots(spark, d), "snapshot_ts", tb.NOW, days=P.snapshot_retention_days)
    return kept.select("station_id", "snapshot_ts", "num_bikes_available")


@query(
    "SNK-08",
    tb.with_(tb.SNAPSHOTS)
    + f"""SELECT date_trunc('day', snapshot_ts)::TIMESTAMP AS day, count(*) FILTER (WHERE snapshot_ts >= TIMESTAMP '{tb.NOW}' - INTERVAL 30 HOUR) AS kept_rows,
count(*) FILTER (WHERE snapshot_ts < TIMESTAMP '{tb.NOW}' - INTERVAL 30 HOUR) AS removed_rows FROM snapshots GROUP BY 1""",
)
def retention_by_day(spark: SparkSession, d: str) -> DataFrame:
    """What retention keeps and removes per day, on the table as it stands."""
    out = sk.prune_partitions(tb.snapshots(spark, d), "snapshot_ts", tb.NOW, 30)
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "SNK-09",
    f"""WITH h AS (SELECT o_orderpriority AS station_short_name, o_orderdate AS hour_ts, count(*) AS departures FROM orders GROUP BY 1, 2)
SELECT *, '{TRUE_LABEL}' AS label_source FROM h WHERE hour_ts >= (SELECT max(hour_ts) - INTERVAL 6 MONTH FROM h)""",
)
def bootstrap_load(spark: SparkSession, d: str) -> DataFrame:
    hourly = tb.load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("station_short_name"), F.col("o_orderdate").alias("hour_ts")).agg(
        F.count("*").alias("departures")
    )
    return lb.bootstrap(hourly, 6).drop("n_intervals")


@query(
    "SNK-10",
    tb.with_(_LABELLED) + f"SELECT station_short_name, hour_ts, departures FROM labelled WHERE label_source = '{TRUE_LABEL}'",
)
def export_label_csv(spark: SparkSession, d: str) -> DataFrame:
    """One label exported with a header and read back."""
    path = scratch(spark, "export")
    true, _ = _two_labels(spark, d)
    sk.export_csv(true, path)
    return spark.read.option("header", True).schema("station_short_name string, hour_ts timestamp_ntz, departures double").csv(path)


@query(
    "SNK-06 SRC-16 SCL-15",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("entity_hours"))
    + f"SELECT entity_id, hour_ts, departures, {tb.lags_sql((1, 24, 168))}, NULL::DOUBLE AS unheard_of FROM panel",
)
def json_payload_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Features packed into JSON and unpacked; an unknown name comes back NULL."""
    rows = pn.add_lags(tb.entity_panel(spark, d).drop("missing_run_length"), P.but(lag_hours=(1, 24, 168)))
    return tbl.unpack_features(sk.pack_features(rows), ["departures", "lag_1h", "lag_24h", "lag_168h", "unheard_of"])


@query(
    "SRC-16 SCL-15",
    "SELECT CAST(user_id AS VARCHAR) AS entity_id, ts AS hour_ts, 'k' AS name, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS value FROM events",
)
def props_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.load(spark, d, "events").select(F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("hour_ts"), F.col("props").alias("payload"))
    return tbl.payload_entries(rows)


@query(
    "WIN-09",
    """SELECT user_id, arg_min(event_id, ts) AS first_event, min(ts) AS first_ts, arg_max(event_id, ts) AS last_event, max(ts) AS last_ts FROM events GROUP BY 1""",
)
def first_and_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.load(spark, d, "events").select("user_id", "event_id", "ts")
    first = first_per_key(rows, ["user_id"], ["ts", "event_id"]).withColumnsRenamed({"event_id": "first_event", "ts": "first_ts"})
    last = latest_per_key(rows, ["user_id"], ["ts", "event_id"]).withColumnsRenamed({"event_id": "last_event", "ts": "last_ts"})
    return first.join(last, "user_id")


@query(
    "SET-02",
    tb.with_(tb.STATIONS)
    + """, a AS (SELECT short_name, station_id, capacity FROM stations WHERE entity_id <> 'BUILDING'),
b AS (SELECT short_name, 'late-' || station_id AS station_id, capacity + 100 AS capacity FROM stations WHERE entity_id <> 'MACHINERY')
SELECT * FROM a UNION ALL SELECT * FROM b WHERE short_name NOT IN (SELECT short_name FROM a)""",
)
def station_info_union(spark: SparkSession, d: str) -> DataFrame:
    info = tb.stations(spark, d)
    early = info.where("entity_id <> 'BUILDING'").select("short_name", "station_id", "capacity")
    late = info.where("entity_id <> 'MACHINERY'").select(
        "short_name", F.concat(F.lit("late-"), "station_id").alias("station_id"), (F.col("capacity") + 100).alias("capacity")
    )
    return lb.merge_station_info([early, late])


@query(
    "FLT-16 SCL-18",
    tb.with_(tb.HOURLY)
    + """, r AS (SELECT o_orderkey, m, CASE WHEN o_orderkey % 5 = 0 THEN m + INTERVAL 1 HOUR
            ELSE date_trunc('hour', m + to_minutes(CAST(o_orderkey % 50 - 10 AS INTEGER) * 40)) END AS target_hour
      FROM orders, (SELECT max(hour_ts) AS m FROM hourly))
SELECT o_orderkey, target_hour, epoch(target_hour - m) / 3600.0::DOUBLE AS hours_ahead,
CASE WHEN epoch(target_hour - m) / 3600 > 24 THEN 'reject' WHEN epoch(target_hour - m) / 3600 > 1 THEN 'warn' ELSE 'ok' END AS status,
round(epoch(target_hour - m) / 3600.0::DOUBLE, 2) AS window_age FROM r""",
)
def forecast_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Requests around the newest hour; those without an hour ask for the next one."""
    latest = score.latest_hour(tb.hourly(spark, d))
    asked = F.timestamp_add("MINUTE", (((F.col("o_orderkey") % 50) - 10) * 40).cast("int"), latest.scalar())
    requests = tb.load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, asked).alias("requested_hour"))
    out = score.check_horizon(requests, latest, P).withColumn("_m", latest.scalar())
    return out.withColumn("window_age", age_hours("_m", "target_hour")).select("o_orderkey", "target_hour", "hours_ahead", "status", "window_age")


@query(
    "AGG-11",
    "SELECT 'events' AS name, max(ts) AS latest, count(*) AS n_rows FROM events UNION ALL SELECT 'orders', max(o_orderdate), count(*) FROM orders "
    "UNION ALL SELECT 'lineitem', max(l_shipdate), count(*) FROM lineitem",
)
def newest_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.newest_rows({"events": (tb.load(spark, d, "events"), "ts"), "orders": (tb.load(spark, d, "orders"), "o_orderdate"), "lineitem": (tb.load(spark, d, "lineitem"), "l_shipdate")})


@query(
    "AGG-18",
    tb.with_(tb.SNAPSHOTS, _LABELLED)
    + f"""SELECT (SELECT count(DISTINCT snapshot_ts) FROM snapshots WHERE snapshot_ts > TIMESTAMP '{tb.NOW}' - INTERVAL 1 HOUR) AS snapshots_1h,
count(DISTINCT hour_ts) FILTER (WHERE hour_ts > TIMESTAMP '{tb.NOW}' - INTERVAL 24 HOUR) AS proxy_hours_24h, max(hour_ts) AS latest_proxy_hour
FROM labelled WHERE label_source = '{PROXY_LABEL}'""",
)
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    true, proxy = _two_labels(spark, d)
    both = lb.with_label(true, TRUE_LABEL).unionByName(lb.with_label(proxy, PROXY_LABEL))
    return reports.ingest_summary(tb.snapshots(spark, d), both, tb.NOW, P)


@query(
    "AGG-21 JOIN-11",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("entity_hours"), tb.PREDICTIONS)
    + "SELECT model_version, count(*) AS n_rows, round(avg(CASE WHEN predicted > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM predictions GROUP BY 1",
)
def positive_prediction_share(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.predictions(spark, d).withColumn("predicted", F.when(F.col("predicted") > 0, F.col("predicted")))
    return tb.rounded(ev.coverage(rows, by=["model_version"]), 6, "coverage")
