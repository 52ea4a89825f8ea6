"""Queries: rolling accuracy, drift, freshness, cooldown, decisions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.coerce import safe_ratio
from demandspark.functions.stats import METRICS
from demandspark.functions.times import utc_wall
from demandspark.operators import drift as dr
from demandspark.operators import evaluate as ev
from demandspark.operators import monitor as mo
from demandspark.operators import panel as pn
from demandspark.operators import promote as pr
from demandspark.operators import train as tr
from demandspark.plans import features as ft
from demandspark.plans import testbed as tb
from demandspark.plans.registry import query
from demandspark.schemas import TABLES
from demandspark.session import materialise, scratch
from demandspark.sources import tables as tbl
from demandspark.streaming import snapshots as ss
from demandspark.streaming.matching import match_stream

# Fewer pairs per day than a real network has, so the limits are lowered to match.
P = tb.PARAMS.but(min_samples=40, mae_threshold=1000.0, mae_degradation_ratio=1.02, rank_buckets=64)
_MATCHED = (tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("entity_hours"), tb.PREDICTIONS)
_END = f"date_trunc('hour', TIMESTAMP '{tb.NOW}')"
_RECENT = f"""recent AS (SELECT * FROM matched WHERE target_hour_ts >= {_END} - INTERVAL 24 HOUR AND target_hour_ts < {_END}),
acc AS (SELECT {_END} - INTERVAL 24 HOUR AS window_start, {_END} AS window_end, count(*) AS n,
        avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse FROM recent),
acc2 AS (SELECT window_start, window_end, n AS n_samples, CASE WHEN n >= 40 THEN mae END AS rolling_mae, CASE WHEN n >= 40 THEN rmse END AS rolling_rmse,
        n >= 40 AS evaluated, CASE WHEN n = 0 THEN 'none_matched' WHEN n < 40 THEN 'too_few_pairs' END AS not_evaluated_reason FROM acc),
ref AS (SELECT min(mae) AS ref_mae FROM cand),
judged AS (SELECT *, CASE WHEN rolling_mae > 1000 THEN 'above_ceiling' WHEN ref_mae > 0 AND rolling_mae > 1.02 * ref_mae THEN 'above_holdout' END AS breach_reason FROM acc2, ref)"""
# Candidates are the naive forecasts on the last two weeks; the best one is the champion in the registry.
_CANDS = """test AS (SELECT * FROM lagged WHERE hour_ts >= (SELECT max(hour_ts) - INTERVAL 336 HOUR FROM lagged) AND departures IS NOT NULL),
cand AS (SELECT 'lag_24h' AS name, avg(abs(departures - lag_24h)) AS mae, sqrt(avg((departures - lag_24h) ** 2)) AS rmse FROM test WHERE lag_24h IS NOT NULL
  UNION ALL SELECT 'lag_168h', avg(abs(departures - lag_168h)), sqrt(avg((departures - lag_168h) ** 2)) FROM test WHERE lag_168h IS NOT NULL
  UNION ALL SELECT 'lag_1h', avg(abs(departures - lag_1h)), sqrt(avg((departures - lag_1h) ** 2)) FROM test WHERE lag_1h IS NOT NULL)"""
_LAGGED = f"lagged AS (SELECT entity_id, hour_ts, departures, {tb.lags_sql()} FROM panel)"
_JUDGED = (*_MATCHED, _CANDS, _RECENT)


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """The feature rows that were served, written once."""
    return materialise(ft.lagged_panel(spark, d), "panel")


def _live_model(spark: SparkSession, lagged: DataFrame) -> DataFrame:
    """The registry after the first promotion: the best naive forecast, with the window it was judged to train on."""
    hours = lagged.where("departures is not null").select("hour_ts")
    split = ev.chronological_split(pn.known_target(pn.drop_warmup(lagged, P, lagged.select("hour_ts"))), P, hours)
    cands = _scored(lagged).withColumns(
        {"path": F.concat(F.lit("models/"), "name"), "kind": F.col("name"), "score_in_process": F.col("mae"), "label_provenance": F.lit("trip_csv")}
    )
    registry = spark.createDataFrame([], TABLES["model_registry"])
    row = pr.record(pr.decide(cands, registry, P), cands, registry, P, window=tr.training_window(split))
    return materialise(pr.current_champion(row), "registry")


def _accuracy(spark: SparkSession, d: str, live: DataFrame) -> DataFrame:
    matched = ft.matched(spark, d)
    reference = live.select("champion.score_as_served").scalar()
    return mo.with_breach(mo.rolling_accuracy(matched, tb.NOW, P), reference, P)


@query(
    "MON-01",
    tb.with_(*_JUDGED)
    + "SELECT window_start, window_end, n_samples, round(rolling_mae, 6) AS rolling_mae, round(rolling_rmse, 6) AS rolling_rmse, evaluated, not_evaluated_reason FROM acc2",
)
def rolling_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(mo.rolling_accuracy(ft.matched(spark, d), tb.NOW, P), 6, "rolling_mae", "rolling_rmse")


def _landed_weekly(spark: SparkSession, rows: DataFrame, hour: str, name: str, closing: dict) -> str:
    """Rows landed as files, the weeks in order and unordered within; then one row far later, which closes all others."""
    path = scratch(spark, name)
    first = rows.agg(F.min(F.to_date(hour))).scalar()
    weeks = rows.withColumn("_week", F.floor(F.datediff(F.to_date(hour), first) / 7))
    for week in range((weeks.agg(F.max("_week")).first()[0] or 0) + 1):
        weeks.where(F.col("_week") == week).drop("_week").repartition(4, hour).write.mode("append").parquet(path)
    last = rows.agg(F.timestamp_add("DAY", F.lit(60), F.max(hour)).alias(hour))
    fields = [F.col(hour) if f.name == hour else F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]
    last.select(*fields).coalesce(1).write.mode("append").parquet(path)
    return path


@query(
    "MON-01 JOIN-09 WIN-07",
    tb.with_(*_MATCHED)
    + """SELECT s.entity_id, s.target_hour_ts, s.predicted, s.model_version, o.departures AS actual
FROM served s LEFT JOIN entity_hours o ON o.entity_id = s.entity_id AND o.hour_ts = s.target_hour_ts""",
)
def stream_match(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and station-hours as two streams: every predicted hour leaves once, with its demand or without."""
    made, seen = materialise(tb.predictions(spark, d), "predictions"), materialise(tb.hourly(spark, d), "hourly")
    landed = [
        _landed_weekly(spark, made, "target_hour_ts", "made", {"entity_id": "closing", "predicted": 0.0}),
        _landed_weekly(spark, seen, "hour_ts", "seen", {"station_short_name": "closing", "departures": 0}),
    ]
    streams = [ss.table_stream(spark, p, df.schema, 16) for p, df in zip(landed, (made, seen), strict=True)]
    out = scratch(spark, "matched-out")
    # A week's files may be read in any order, so hours may come a week late.
    stream = match_stream(*streams, tb.station_entity(spark, d), "8 days")
    ss.require_complete(ss.run_available(stream, out, f"{out}-state"))
    rows = spark.read.parquet(out)
    return rows.select("entity_id", utc_wall(rows, "target_hour_ts").alias("target_hour_ts"), "predicted", "model_version", "actual")


@query(
    "MON-02",
    tb.with_(*_JUDGED)
    + "SELECT n_samples, round(rolling_mae, 6) AS rolling_mae, round(ref_mae, 6) AS holdout_mae, breach_reason IS NOT NULL AS breached, breach_reason FROM judged",
)
def breach_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The recorded error of the live model is the measure of the rolling one."""
    out = _accuracy(spark, d, _live_model(spark, _panel(spark, d)))
    return tb.rounded(out, 6, "rolling_mae", "holdout_mae").select("n_samples", "rolling_mae", "holdout_mae", "breached", "breach_reason")


# Monitoring history: one row per order day, breached on days with many urgent orders, some held back.
def _history(spark: SparkSession, d: str) -> DataFrame:
    days = tb.load(spark, d, "orders").groupBy(F.col("o_orderdate").alias("computed_at")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    breached = F.col("urgent") >= 1
    reason = F.when(breached & (F.dayofmonth("computed_at") % 3 == 0), F.concat(F.lit("accuracy: high; [suppressed] 2.0h")))
    return days.select(
        "computed_at", breached.alias("breached"), F.when(reason.isNotNull(), reason).when(breached, F.lit("accuracy: high")).alias("breach_reason"),
        F.col("n").cast("double").alias("rolling_mae"), F.when(F.col("n") > 1, safe_ratio(F.col("urgent").cast("double"), F.col("n"))).alias("drift_share"),
    )


_HISTORY = """history AS (
  SELECT computed_at, urgent >= 1 AS breached,
         CASE WHEN urgent >= 1 AND day(computed_at) % 3 = 0 THEN 'accuracy: high; [suppressed] 2.0h' WHEN urgent >= 1 THEN 'accuracy: high' END AS breach_reason,
         CAST(n AS DOUBLE) AS rolling_mae, CASE WHEN n > 1 THEN urgent / n END AS drift_share
  FROM (SELECT o_orderdate AS computed_at, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS urgent FROM orders GROUP BY 1))"""
_COOL = """cool AS (SELECT c.now_at, greatest(0, 6 - epoch(c.now_at - m) / 3600.0::DOUBLE) AS cooldown_hours
  FROM (SELECT max(computed_at) AS m FROM history WHERE breached AND breach_reason NOT LIKE '%[suppressed]%') h,
       (SELECT max(computed_at) + to_hours(x) AS now_at FROM history, (SELECT unnest([1, 4, 9, 40]) AS x) GROUP BY x) c)"""


@query("MON-09 SCL-19", tb.with_(_HISTORY, _COOL) + "SELECT now_at, round(cooldown_hours, 4) AS cooldown_hours FROM cool")
def cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Hours of cooldown left at four moments after the newest monitoring row."""
    history = _history(spark, d)
    newest = history.agg(F.max("computed_at")).first()[0]
    parts = []
    for hours in (1, 4, 9, 40):
        now = newest + timedelta(hours=hours)
        parts.append(mo.cooldown_left(history, now, P).withColumn("now_at", F.lit(str(now)).cast("timestamp_ntz")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return tb.rounded(out, 4, "cooldown_hours")


@query(
    "MON-12",
    tb.with_(_HISTORY) + "SELECT computed_at, round(drift_share, 6) AS drift_share FROM history WHERE drift_share IS NOT NULL ORDER BY computed_at",
)
def metric_series(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(mo.metric_series(_history(spark, d), "drift_share"), 6, "drift_share")


@query(
    "SRC-17 TOP-04 SNK-07",
    tb.with_(_HISTORY) + "SELECT computed_at, breached, rolling_mae FROM history ORDER BY computed_at DESC LIMIT 50",
)
def newest_metrics(spark: SparkSession, d: str) -> DataFrame:
    return tbl.newest(_history(spark, d), 50).select("computed_at", "breached", "rolling_mae")


# Times of the four streams watched by the freshness check, and their limits in minutes.
_FRESH = f"""fresh AS (
  SELECT name, latest, date_diff('microsecond', latest, TIMESTAMP '{tb.NOW}') / 60000000.0::DOUBLE AS age_minutes, lim AS threshold_minutes FROM (
    SELECT 'snapshots' AS name, max(ts) FILTER (WHERE ts <= TIMESTAMP '{tb.NOW}') AS latest, 30.0::DOUBLE AS lim FROM events
    UNION ALL SELECT 'purchases', max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-20' AND event_type = 'purchase'), 180.0 FROM events
    UNION ALL SELECT 'orders', max(o_orderdate), 30.0 FROM orders
    UNION ALL SELECT 'nothing', NULL, 30.0)),
checks AS (SELECT *, coalesce(age_minutes <= threshold_minutes, false) AS healthy,
  name || CASE WHEN latest IS NULL THEN ':no_rows' WHEN age_minutes <= threshold_minutes THEN ':fresh' ELSE ':stale' END AS detail
  FROM fresh)"""


def _checks(spark: SparkSession, d: str) -> DataFrame:
    events, orders = tb.load(spark, d, "events"), tb.load(spark, d, "orders")
    now = F.lit(tb.NOW).cast("timestamp_ntz")
    streams = {
        "snapshots": (events.where(F.col("ts") <= now), "ts", P.snapshot_max_age_minutes, False),
        "purchases": (events.where("event_type = 'purchase' and ts <= timestamp_ntz'2024-01-20'"), "ts", P.departures_max_age_minutes, True),
        "orders": (orders, "o_orderdate", 30.0, False),
        "nothing": (orders.where("o_orderdate < timestamp_ntz'1990-01-01'"), "o_orderdate", 30.0, False),
    }
    return mo.freshness(streams, tb.NOW, P)


@query(
    "STR-11",
    tb.with_(_FRESH) + "SELECT name, latest, round(age_minutes, 4) AS age_minutes, threshold_minutes, healthy, detail FROM checks",
)
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(_checks(spark, d), 4, "age_minutes")


@query(
    "STR-11 MON-13",
    tb.with_(_FRESH)
    + f""", o AS (SELECT bool_and(healthy) AS live, string_agg(detail, ',' ORDER BY detail) FILTER (WHERE NOT healthy) AS failing FROM checks),
h AS (SELECT CASE WHEN max(ts) IS NULL THEN 'none' WHEN date_trunc('hour', max(ts)) >= TIMESTAMP '2024-02-20' - INTERVAL {P.history_freshness_hours} HOUR THEN 'fresh' ELSE 'stale' END AS src FROM events),
n AS (SELECT live, src, concat_ws('; ', CASE WHEN NOT live THEN 'streams ' || failing END, CASE WHEN src <> 'fresh' THEN 'history ' || src END) AS notes FROM o, h)
SELECT CASE WHEN notes = '' THEN 'ok' ELSE 'degraded' END AS status, src AS history_source, live AS data_live, notes AS warnings FROM n""",
)
def health_verdict(spark: SparkSession, d: str) -> DataFrame:
    source = tbl.history_source(tbl.recent_history(tb.hourly(spark, d), None, "2024-02-20 00:00:00", P)).select("source").scalar()
    return mo.health(_checks(spark, d), source)


# --- drift --------------------------------------------------------------------------------------

_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_days")
_SPLIT_DAY = "1998-06-01"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items shipped early and late; only the days since the first shipment drift."""
    rows = tb.load(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("l_days"), "l_shipdate",
    )
    border = F.lit(_SPLIT_DAY).cast("timestamp_ntz")
    return rows.where(F.col("l_shipdate") < border).drop("l_shipdate"), rows.where(F.col("l_shipdate") >= border).drop("l_shipdate")


_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {e} AS v, l_shipdate < TIMESTAMP '{_SPLIT_DAY}' AS is_ref FROM lineitem"
    for f, e in [*[(f, f) for f in _FEATURES[:4]], ("l_days", "CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE)")]
) + ")"
_PSI = """edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM long WHERE is_ref GROUP BY 1),
bounds AS (SELECT feature, len(e) AS k, unnest(e[2:len(e) - 1]) AS edge FROM edges),
binned AS (SELECT l.feature, l.v, l.is_ref, l.n, (SELECT count(*) FROM bounds b WHERE b.feature = l.feature AND b.edge <= l.v) AS bin
  FROM (SELECT feature, v, is_ref, count(*) AS n FROM long GROUP BY 1, 2, 3) l),
grid AS (SELECT feature, len(e) AS k, unnest(generate_series(0, len(e) - 2)) AS bin FROM edges),
cells AS (SELECT g.feature, g.k, g.bin, coalesce(sum(n) FILTER (WHERE is_ref), 0) AS r, coalesce(sum(n) FILTER (WHERE NOT is_ref), 0) AS c
  FROM grid g LEFT JOIN binned b ON b.feature = g.feature AND b.bin = g.bin GROUP BY 1, 2, 3),
shares AS (SELECT feature, (r + 0.5) / (sum(r) OVER (PARTITION BY feature) + 0.5 * k) AS rs, (c + 0.5) / (sum(c) OVER (PARTITION BY feature) + 0.5 * k) AS cs FROM cells),
psi AS (SELECT feature, sum((cs - rs) * ln(cs / rs)) AS psi FROM shares GROUP BY 1)"""


@query("MON-03", tb.with_(_LONG, _PSI) + "SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_by_feature(spark: SparkSession, d: str) -> DataFrame:
    ref, cur = _halves(spark, d)
    return tb.rounded(dr.psi(ref, cur, list(_FEATURES)), 6, "psi")


_KS = """vals AS (SELECT feature, v, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM long GROUP BY 1, 2),
cums AS (SELECT feature, v, sum(r) OVER w AS cr, sum(c) OVER w AS cc, lead(v) OVER w AS nv FROM vals WINDOW w AS (PARTITION BY feature ORDER BY v)),
sizes AS (SELECT feature, sum(r) AS n, sum(c) AS m FROM vals GROUP BY 1),
dist AS (SELECT feature, n, m, max(abs(cr / n - cc / m)) AS ks, sum(abs(cr / n - cc / m) * coalesce(nv - v, 0)) AS wasserstein FROM cums JOIN sizes USING (feature) GROUP BY 1, 2, 3),
lam AS (SELECT *, sqrt(CAST(n AS DOUBLE) * m / (n + m)) * ks AS lam FROM dist),
tests AS (SELECT feature, CAST(n AS BIGINT) AS n_ref, CAST(m AS BIGINT) AS n_cur, ks, wasserstein,
  CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, (SELECT sum((CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2 * lam * lam * k * k)) FROM (SELECT unnest(generate_series(1, 100)) AS k)))) END AS p_value
  FROM lam)"""


@query(
    "MON-05",
    tb.with_(_LONG, _KS)
    + "SELECT feature, n_ref, n_cur, round(ks, 6) AS ks, round(CAST(p_value AS DOUBLE), 6) AS p_value, round(wasserstein, 4) AS wasserstein FROM tests",
)
def two_sample_by_feature(spark: SparkSession, d: str) -> DataFrame:
    ref, cur = _halves(spark, d)
    out = dr.two_sample(ref, cur, list(_FEATURES), P.rank_buckets).drop("ref_std")
    return tb.rounded(tb.rounded(out, 6, "ks", "p_value"), 4, "wasserstein")


@query(
    "MON-05",
    tb.with_(_LONG, _KS)
    + """, spread AS (SELECT feature, stddev_pop(v) AS sd FROM long WHERE is_ref GROUP BY 1)
SELECT feature, 'p_value' AS method, round(CAST(p_value AS DOUBLE), 4) AS value, 0.05::DOUBLE AS threshold, p_value < 0.05 AS drifted FROM tests
UNION ALL SELECT feature, 'distance', round(wasserstein / sd, 4), 0.1::DOUBLE, wasserstein / sd > 0.1 FROM tests JOIN spread USING (feature)""",
)
def two_sample_verdicts(spark: SparkSession, d: str) -> DataFrame:
    ref, cur = _halves(spark, d)
    tests = materialise(dr.two_sample(ref, cur, list(_FEATURES), P.rank_buckets), "tests")
    both = dr.test_verdicts(tests, "p_value").unionByName(dr.test_verdicts(tests, "distance"))
    return tb.rounded(both, 4, "value")


_SUMMARY = """summary AS (SELECT sum(CASE WHEN psi > 0.25 THEN 1.0 ELSE 0.0 END) / count(*) AS drift_share,
  sum(CASE WHEN psi > 0.25 THEN 1.0 ELSE 0.0 END) / count(*) > 0.15 AS dataset_drift,
  count(*) AS n_features, count(*) FILTER (WHERE psi > 0.25) AS n_drifted, coalesce(string_agg(feature, ', ' ORDER BY psi DESC, feature) FILTER (WHERE psi > 0.25), '') AS drifted_features
  FROM psi)"""
_DP = P.but(drift_share_threshold=0.15)


def _drift(spark: SparkSession, d: str) -> DataFrame:
    """The early rows' profile, as it is stored when a model goes live, against the late rows."""
    ref, cur = _halves(spark, d)
    return dr.profile_drift(dr.profile(ref, list(_FEATURES), _DP.psi_bins), cur, _DP)


@query(
    "MON-04",
    tb.with_(_LONG, _PSI, _SUMMARY)
    + f"""SELECT round(CAST(drift_share AS DOUBLE), 6) AS drift_share, dataset_drift, n_features, n_drifted, drifted_features,
(SELECT count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '{_SPLIT_DAY}') AS reference_rows,
(SELECT count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '{_SPLIT_DAY}') AS current_rows, true AS evaluated FROM summary""",
)
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    out = _drift(spark, d).drop("reason")
    return tb.rounded(out.withColumn("drifted_features", F.array_join("drifted_features", ", ")), 6, "drift_share")


@query(
    "MON-04 MON-07 MON-08 FLT-12",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("entity_hours"), _LAGGED, ft.SPLIT)
    + ", win AS (SELECT min(hour_ts) AS a, max(hour_ts) AS b FROM split WHERE split = 'train'), long AS ("
    + " UNION ALL ".join(
        f"SELECT 'lag_{h}h' AS feature, lag_{h}h AS v, hour_ts <= b AS is_ref FROM lagged, win WHERE lag_{h}h IS NOT NULL "
        "AND (hour_ts BETWEEN a AND b OR (hour_ts >= TIMESTAMP '2024-01-26 12:30:00' AND hour_ts < TIMESTAMP '2024-01-29 12:30:00'))"
        for h in P.lag_hours
    )
    + "), " + _PSI + "SELECT feature, round(psi, 6) AS psi, psi > 0.25 AS drifted FROM psi",
)
def feature_drift(spark: SparkSession, d: str) -> DataFrame:
    """At promotion the live model's training window is stored as a profile; monitoring compares the features of the
    last days with it, from counts per day, and reads no training row."""
    lagged = _panel(spark, d)
    champion = _live_model(spark, lagged)
    start, end = (champion.select(f"champion.train_{side}").scalar() for side in ("start", "end"))
    trained = lagged.where((F.col("hour_ts") >= start) & (F.col("hour_ts") <= end))
    reference = dr.profile(trained, P.lag_features, P.psi_bins)
    served = dr.current_features(lagged, mo.local_now(tb.NOW, P), 72).withColumn("day", F.to_date("hour_ts"))
    per_day = dr.served_counts(served, reference, P.lag_features, ["day"])
    scored = dr.psi_of_counts(reference, per_day).withColumn("drifted", F.col("psi") > P.psi_threshold)
    return tb.rounded(scored, 6, "psi")


@query(
    "MON-10 SNK-07",
    tb.with_(*_JUDGED, _LONG, _PSI, _SUMMARY, _HISTORY)
    + f""", cool AS (SELECT greatest(0, 6 - epoch(TIMESTAMP '{tb.NOW}' - max(computed_at)) / 3600.0::DOUBLE) AS left_h FROM history WHERE breached AND breach_reason NOT LIKE '%[suppressed]%'),
txt AS (SELECT j.*, s.drift_share, s.dataset_drift, CASE WHEN evaluated AND breach_reason IS NOT NULL THEN 'accuracy:' || breach_reason END AS e,
  CASE WHEN s.dataset_drift THEN 'drift:share_above_limit' END AS dt, left_h FROM judged j, summary s, cool)
SELECT TIMESTAMP '{tb.NOW}' AS computed_at, window_start, window_end, (SELECT name FROM cand ORDER BY mae, name LIMIT 1) AS model_name, '1' AS model_version,
n_samples, round(rolling_mae, 6) AS rolling_mae, round(rolling_rmse, 6) AS rolling_rmse,
round(CAST(drift_share AS DOUBLE), 6) AS drift_share, dataset_drift, (e IS NOT NULL OR dt IS NOT NULL) AND left_h = 0 AS breached,
CASE WHEN e IS NULL AND dt IS NULL THEN 'none' ELSE concat_ws('; ', e, dt, CASE WHEN left_h > 0 THEN '[suppressed]' END) END AS breach_reason
FROM txt""",
)
def retrain_decision(spark: SparkSession, d: str) -> DataFrame:
    """The decision as it is read back from the monitoring log that it was appended to."""
    live = _live_model(spark, _panel(spark, d))
    model = (live.select("champion.model_name").scalar(), live.select("champion.version").scalar())
    out = mo.retrain_decision(_accuracy(spark, d, live), _drift(spark, d), mo.cooldown_left(_history(spark, d), tb.NOW, P), _DP, tb.NOW, model)
    path = scratch(spark, "metrics")
    mo.store_metrics(out, path)
    return tb.rounded(spark.read.parquet(path).drop("day"), 6, "rolling_mae", "rolling_rmse", "drift_share")


# --- champion and challenger --------------------------------------------------------------------

_PANELS = (tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.dense("entity_hours"), _LAGGED)


def _scored(lagged: DataFrame) -> DataFrame:
    newest = lagged.agg(F.timestamp_add("HOUR", F.lit(-336), F.max("hour_ts"))).scalar()
    test = lagged.where(F.col("hour_ts") >= newest).where("departures is not null")
    long = test.unpivot(["entity_id", "hour_ts", "departures"], ["lag_24h", "lag_168h", "lag_1h"], "name", "predicted")
    return ev.regression_metrics(long, "departures", "predicted", ["name"])


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _scored(ft.lagged_panel(spark, d))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Versions that went live earlier; the newest one scored twice the mean hourly demand of its segment."""
    seg = tb.entity_hours(spark, d).groupBy("entity_id").agg(F.avg("departures").alias("m"), F.count("*").alias("n"))
    return seg.select(
        (F.ascii("entity_id") * 1000 + F.length("entity_id")).cast("int").alias("version"), F.col("entity_id").alias("model_name"),
        F.lit("production").alias("stage"), (F.col("m") * 2).alias("score_as_served"), F.lit("trip_csv").alias("label_provenance"),
    )


_REG = """reg AS (SELECT ascii(entity_id) * 1000 + length(entity_id) AS version, entity_id, 2 * avg(departures) AS s FROM entity_hours GROUP BY 2),
champ AS (SELECT arg_max(s, version) AS champ FROM reg)"""


@query("TOP-05", tb.with_(*_PANELS, _CANDS) + "SELECT name AS challenger, round(rmse, 6) AS challenger_score FROM cand ORDER BY rmse, name LIMIT 1")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return tb.rounded(pr.best_candidate(_candidates(spark, d), "rmse"), 6, "challenger_score")


@query(
    "ML-11",
    tb.with_(*_PANELS, _CANDS, _REG)
    + """, best AS (SELECT name, mae FROM cand ORDER BY mae, name LIMIT 1),
x AS (SELECT name, mae, champ, (champ - mae) / abs(champ) AS imp FROM best, champ)
SELECT imp > 0.02 AS promote, name AS challenger, round(mae, 6) AS challenger_score, round(champ, 6) AS champion_score, round(imp, 6) AS improvement,
CASE WHEN imp > 0.02 THEN 'gain_above_margin' ELSE 'gain_within_margin' END AS reason FROM x""",
)
def champion_challenger(spark: SparkSession, d: str) -> DataFrame:
    out = pr.decide(_candidates(spark, d), _registry(spark, d), P)
    return tb.rounded(out, 6, "challenger_score", "champion_score", "improvement")


@query(
    "ML-11 ML-12",
    tb.with_(*_PANELS, _CANDS)
    + """, best AS (SELECT name, mae FROM cand ORDER BY mae, name LIMIT 1)
SELECT CAST(1 AS INTEGER) AS version, name AS model_name, 'models/' || name AS path, 'mae' AS metric, round(mae, 6) AS score_as_served, 'trip_csv' AS label_provenance, 'production' AS stage,
'first_model' AS reason FROM best""",
)
def first_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Without a champion the best candidate goes live as version 1."""
    cands = _candidates(spark, d).withColumns(
        {"path": F.concat(F.lit("models/"), "name"), "kind": F.col("name"), "score_in_process": F.col("mae"), "label_provenance": F.lit("trip_csv")}
    )
    empty = _registry(spark, d).where("version < 0")
    row = pr.record(pr.decide(cands, empty, P), cands, empty, P)
    return tb.rounded(row, 6, "score_as_served").select("version", "model_name", "path", "metric", "score_as_served", "label_provenance", "stage", "reason")


@query(
    "AGG-07 SCL-13",
    "SELECT l_returnflag AS grp, " + tb.metrics_sql("l_quantity", "(l_extendedprice / 1000)") + " FROM lineitem GROUP BY 1",
)
def metrics_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = tb.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("predicted"))
    return tb.rounded(ev.regression_metrics(rows, "l_quantity", "predicted", ["grp"]), 6, *METRICS)
