"""Queries: entity fitting, candidate models, evaluation and batch scoring with Spark ML.

Fitted numbers depend on library and seed, so the results state what does not: keys, counts, windows and bounds.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandspark.operators import entities as ent
from demandspark.operators import evaluate as ev
from demandspark.operators import panel as pn
from demandspark.operators import promote as pr
from demandspark.operators import score as sc
from demandspark.operators import sequence as sq
from demandspark.operators import train as tr
from demandspark.params import TRUE_LABEL
from demandspark.plans import features as ft
from demandspark.plans import testbed as tb
from demandspark.plans.registry import query
from demandspark.session import materialise, scratch
from demandspark.sinks import tables as sk

P = tb.PARAMS.but(n_clusters=8)


def _training(spark: SparkSession, d: str) -> DataFrame:
    """The training set, written once: several fits and evaluations read it."""
    data = tr.training_set(tb.hourly(spark, d), tb.station_entity(spark, d), tb.entities(spark, d), tb.weather(spark, d), P)
    return materialise(data, "training")


@query(
    "ML-01 ML-02 SCL-16 SCL-17 JOIN-06 WIN-09",
    tb.with_(tb.STATIONS)
    + f"""SELECT count(*) AS n_mapped, count(DISTINCT short_name) AS n_stations, CAST({P.n_clusters} AS BIGINT) AS n_clusters, count(*) AS n_counted,
CAST(sum(capacity) AS DOUBLE) AS capacity FROM stations WHERE short_name IN (SELECT DISTINCT CAST(user_id AS VARCHAR) FROM events)""",
)
def kmeans_entities(spark: SparkSession, d: str) -> DataFrame:
    """Stations with data clustered, the map frozen and reloaded: every station is in one cluster, and the clusters add
    up to all stations. Which cluster it is depends on the library."""
    scope = tb.hourly(spark, d).select(F.col("station_short_name").alias("short_name"))
    path = scratch(spark, "mapping")
    ent.save_mapping(*ent.fit_entities(tb.stations(spark, d), scope, P), path, P)
    mapping, entities = ent.load_mapping(spark, path, P)
    totals = entities.select(F.struct(F.sum("n_stations").cast("bigint").alias("n"), F.sum("capacity").alias("c"))).scalar()
    row = mapping.agg(
        F.count("*").alias("n_mapped"), F.count_distinct("station_short_name").alias("n_stations"),
        F.count_distinct("entity_id").alias("n_clusters"),
    )
    return row.withColumns({"n_counted": totals["n"], "capacity": totals["c"]})


@query(
    "ML-01",
    tb.with_(tb.STATIONS)
    + "SELECT short_name AS entity_id, lat, lon, CAST(capacity AS DOUBLE) AS capacity, CAST(1 AS BIGINT) AS n_stations FROM stations "
    "WHERE short_name IN (SELECT DISTINCT CAST(user_id AS VARCHAR) FROM events)",
)
def station_entities(spark: SparkSession, d: str) -> DataFrame:
    """Station granularity: every station with data is its own entity."""
    scope = tb.hourly(spark, d).select(F.col("station_short_name").alias("short_name"))
    _, entities = ent.fit_entities(tb.stations(spark, d), scope, P.but(granularity="station"))
    return entities


_SPLIT = (*ft.ENTITY_PANEL, ft.LAGGED, ft.SPLIT)
_FIT_SQL = tb.with_(*_SPLIT) + """SELECT split, count(*) AS n, true AS sound FROM split WHERE split IN ('validation', 'test') GROUP BY 1"""


#: Boosting for the queries: longer steps than the default, so that fewer trees do.
BOOST = {"learning_rate": 0.25, "patience": 4}


def _fit_result(model, data: DataFrame) -> DataFrame:
    """Rows scored per split, and whether the model beats the forecast of the same hour last week. Errors themselves
    depend on library and seed and are tested apart."""
    scored = tr.evaluate(model, data)
    return scored.select("split", "n", (F.col("mae") < F.col("baseline_mae")).alias("sound"))


def _poisson(data: DataFrame):
    return tr.fit_poisson(data.where("split = 'train'"), data.where("split = 'validation'"), P, **BOOST)


@query("ML-04 ML-05 ML-07 AGG-08", _FIT_SQL)
def poisson_fit(spark: SparkSession, d: str) -> DataFrame:
    """Trees boosted on the Poisson deviance until the validation rows stop improving."""
    data = _training(spark, d)
    return _fit_result(_poisson(data), data)


@query("ML-05 ML-07", _FIT_SQL)
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    """The generalised linear model with Poisson errors."""
    data = _training(spark, d)
    return _fit_result(tr.fit_candidates(data, P, ("linear",))["linear"], data)


@query("ML-05 ML-07", _FIT_SQL)
def boosted_fit(spark: SparkSession, d: str) -> DataFrame:
    data = _training(spark, d)
    model = tr.fit_boosted(data.where("split = 'train'"), data.where("split = 'validation'"), P)
    return _fit_result(model, data)


@query(
    "TOP-03",
    """SELECT CAST(i AS INTEGER) AS rank, true AS in_order, 1.0::DOUBLE AS total FROM (SELECT unnest(range(1, 16)) AS i)
WHERE (SELECT count(*) FROM events) > 0""",
)
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """The 15 most important features of a forest: in falling order, and parts of a whole."""
    data = _training(spark, d)
    model = tr.fit_forest(data.where("split = 'train'"), data.where("split = 'validation'"), P)
    total = tr.importance(model, len(P.features)).agg(F.round(F.sum("importance"), 6)).scalar()
    # At most 15 rows.
    order = Window.orderBy(F.col("importance").desc(), "feature")
    top = tr.importance(model, 15).withColumns({"rank": F.row_number().over(order), "above": F.lag("importance").over(order)})
    fits = F.col("importance").between(0.0, F.coalesce("above", F.lit(1.0)))
    return top.select("rank", fits.alias("in_order"), total.alias("total"))


@query(
    "ML-06 WIN-10 JOIN-11 AGG-21",
    tb.with_(*_SPLIT)
    + f""", ctx AS (SELECT entity_id, hour_ts, departures, split, row_number() OVER (PARTITION BY entity_id, split ORDER BY hour_ts DESC) AS rn
  FROM split WHERE split IN ('validation', 'test')),
s AS (SELECT split, count(departures) OVER (PARTITION BY entity_id ORDER BY hour_ts ROWS BETWEEN {P.sequence_length} PRECEDING AND 1 PRECEDING) AS n
  FROM ctx WHERE split = 'test' OR rn <= {P.sequence_length})
SELECT split, count(*) AS n_rows, round(avg(CASE WHEN n = {P.sequence_length} THEN 1.0 ELSE 0.0 END), 6) AS coverage, true AS sound
FROM s WHERE split = 'test' GROUP BY 1""",
)
def sequence_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The second kind of candidate: random kernels over the preceding week, scored on the same split, where it has to
    beat the same hour last week. The hours before a split serve as context of its first rows."""
    data = _training(spark, d).select("entity_id", "hour_ts", "departures", "split")
    panel = tb.entity_panel(spark, d).select("entity_id", "hour_ts", "departures").where("departures is not null")
    train, valid, test = (data.where(F.col("split") == part) for part in ev.SPLITS)
    before = panel.where(F.col("hour_ts") < train.agg(F.min("hour_ts")).scalar())
    length = P.sequence_length

    def complete(part: DataFrame, history: DataFrame) -> DataFrame:
        return pn.sequences(pn.with_context(part, history, length), length, target_flag="is_split_row")

    model = sq.fit(complete(train, before), complete(valid, train), length)
    seen = complete(test, valid)
    forecasts = tr.predict(model, seen)
    week_ago = forecasts.select("entity_id", "hour_ts", F.element_at("sequence", 1).alias("week_ago"))
    aligned = ev.align_predictions(test, forecasts).join(week_ago, ["entity_id", "hour_ts"], "left")
    aligned = materialise(aligned, "aligned")
    errors = [F.avg(F.abs(F.col(c) - F.col("departures"))).alias(c) for c in ("predicted", "week_ago")]
    metrics = aligned.groupBy("split").agg(*errors).select("split", (F.col("predicted") < F.col("week_ago")).alias("sound"))
    return tb.rounded(metrics.join(ev.coverage(aligned, by=["split"]), "split"), 6, "coverage")


@query(
    "ML-08",
    tb.with_(*_SPLIT) + "SELECT count(*) AS n, 0.0::DOUBLE AS gap_ratio, false AS suspicious FROM split WHERE split = 'test'",
)
def as_served_gap(spark: SparkSession, d: str) -> DataFrame:
    """A saved model reloaded and scored on the same holdout: the gap to the in-process error is zero."""
    data = _training(spark, d)
    model = _poisson(data)
    path = scratch(spark, "model")
    model.save(path)
    test = data.where("split = 'test'")
    mae = ev.regression_metrics(tr.predict(model, test), "departures", "predicted").first()["mae"]
    return tb.rounded(tr.as_served(spark, path, test, mae), 9, "gap_ratio").select("n", F.abs("gap_ratio").alias("gap_ratio"), "suspicious")


@query(
    "ML-09 ML-10 FLT-15 SNK-05 SNK-06",
    tb.with_(tb.HOURLY, tb.SMAP, tb.ENTITY_HOURS, tb.STATIONS, tb.ENTITIES)
    + """SELECT entity_id, m + to_hours(CAST(h AS INTEGER)) AS target_hour_ts, round(lat, 6) AS lat, round(lon, 6) AS lon, n_stations, true AS non_negative,
CAST(2 AS BIGINT) AS logged, CAST(1 AS BIGINT) AS served FROM entities, (SELECT max(hour_ts) AS m FROM hourly), (SELECT unnest([1, 2, 3]) AS h)
WHERE entity_id IN (SELECT entity_id FROM entity_hours)""",
)
def score_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next three hours forecast for every entity, twice: predictions are logged each time, the served features of an
    hour are stored once."""
    hourly = tb.hourly(spark, d)
    data = _training(spark, d)
    model = tr.fit_candidates(data, P, ("linear",))["linear"]
    newest = sc.latest_hour(hourly).first()["latest"]
    targets = [newest + timedelta(hours=h) for h in (1, 2, 3)]
    panel = materialise(
        sc.scoring_panel(hourly, tb.station_entity(spark, d), tb.entities(spark, d), tb.weather(spark, d), targets, P), "served"
    )
    scored = sc.score(panel, tb.entities(spark, d), model)
    base = scratch(spark, "log")
    packed = sk.pack_features(panel.drop("departures")).withColumn("day", F.to_date("hour_ts"))
    for _ in range(2):
        sk.append(sc.prediction_log(scored, "linear", "1"), f"{base}/predictions", "target_hour_ts")
        sk.upsert_table(spark, f"{base}/features", packed, ["entity_id", "hour_ts", "day"], ["day"])
    key = ["entity_id", "target_hour_ts"]
    logged = spark.read.parquet(f"{base}/predictions").groupBy(*key).agg(
        F.count("*").alias("logged"), (F.min("predicted") >= 0).alias("non_negative")
    )
    served = spark.read.parquet(f"{base}/features").groupBy("entity_id", F.col("hour_ts").alias("target_hour_ts")).agg(F.count("*").alias("served"))
    out = scored.select(*key, "lat", "lon", "n_stations").join(logged, key, "left").join(served, key, "left")
    return tb.rounded(out, 6, "lat", "lon")


@query(
    "ML-11 ML-12 ML-08 TOP-05",
    tb.with_(*_SPLIT)
    + f"""SELECT CAST(1 AS INTEGER) AS version, (SELECT count(*) FROM smap) AS n_mapped, 'production' AS stage, '{P.promotion_metric}' AS metric, '{TRUE_LABEL}' AS label_provenance, true AS as_fitted,
min(hour_ts) AS train_start, max(hour_ts) AS train_end, '{P.granularity}' AS granularity, CAST({P.seed} AS BIGINT) AS seed FROM split WHERE split = 'train'""",
)
def promotion_round(spark: SparkSession, d: str) -> DataFrame:
    """Two candidates fitted, judged as served, the better one published under a claimed version, with the window and the
    settings it was trained with and the station map that serving loads."""
    data = _training(spark, d)
    test = data.where("split = 'test'")
    results = {}
    for kind, model in tr.fit_candidates(data, P, ("linear", "forest")).items():
        path = scratch(spark, f"model-{kind}")
        model.save(path)
        mae = ev.regression_metrics(tr.predict(model, test), "departures", "predicted").first()["mae"]
        served = tr.as_served(spark, path, test, mae).first()["mae"]
        results[kind] = (path, served, mae, TRUE_LABEL)
    candidates = tr.candidate_table(spark, results)
    base = scratch(spark, "registry")
    ent.save_mapping(tb.station_entity(spark, d), tb.entities(spark, d), f"{base}/mapping", P)
    registry = pr.published(spark, base)
    row = pr.record(
        pr.decide(candidates, registry, P), candidates, registry, P, window=tr.training_window(data), mapping_path=f"{base}/mapping"
    )
    pr.publish(row, base)
    live = pr.current_champion(pr.published(spark, base)).first().champion
    mapping, _ = ent.load_mapping(spark, live.mapping_path, P)
    same = F.abs(F.col("score_as_served") - F.col("score_in_process")) < 1e-9
    return pr.published(spark, base).select(
        "version", "stage", "metric", "label_provenance", same.alias("as_fitted"), "train_start", "train_end", "granularity", "seed",
        mapping.agg(F.count("*")).scalar().alias("n_mapped"),
    )
