import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandspark.functions.calendar import add_seasonal, daylight_hours, easter, holiday_dim, holiday_name, is_holiday
from demandspark.operators import entities as ent
from demandspark.operators import evaluate as ev
from demandspark.operators import panel as pn
from demandspark.params import Params

P = Params()
T0 = datetime(2026, 4, 1)
OBS = "entity_id string, hour_ts timestamp_ntz, departures double"


def obs(spark, values, entity="e", skip=(), start=T0):
    rows = [(entity, start + timedelta(hours=i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, OBS)


def poisson(n, seed=0):
    return np.random.default_rng(seed).poisson(20, n)


def frame(df):
    return df.orderBy("entity_id", "hour_ts").toPandas()


def test_short_gap_is_zero_and_long_gap_stays_unknown(spark):
    out = frame(pn.complete_panel(obs(spark, range(1, 101), skip={3, *range(40, 65)}), P))
    assert len(out) == 100 and out.departures[3] == 0.0 and out.missing_run_length[3] == 1
    assert out.departures[40:65].isna().all() and (out.missing_run_length[40:65] == 25).all()
    kept = frame(pn.complete_panel(obs(spark, range(1, 101), skip=set(range(40, 64))), P))
    assert (kept.departures[40:64] == 0.0).all()


def test_leading_and_trailing_gaps_count(spark):
    both = obs(spark, [1] * 60).unionByName(obs(spark, [1] * 60, "late", skip={*range(30), *range(50, 60)}))
    out = frame(pn.complete_panel(both, P))
    late = out[out.entity_id == "late"].reset_index(drop=True)
    assert len(late) == 60 and late.departures[:30].isna().all() and (late.departures[50:] == 0.0).all()


def test_empty_history_is_an_error(spark):
    with pytest.raises(Exception, match="zero observations"):
        pn.complete_panel(obs(spark, [1]).where("departures < 0"), P).collect()


def test_future_hour_has_features_but_no_target(spark):
    last = T0 + timedelta(hours=199)
    out = frame(pn.add_lags(pn.complete_panel(obs(spark, poisson(200)), P, extra_hours=[last + timedelta(hours=1)]), P))
    row = out.iloc[-1]
    assert pd.isna(row.departures) and not pd.isna(row.lag_1h) and not pd.isna(row.lag_24h)


@pytest.mark.parametrize("method", ["prefix", "frame"])
def test_rolling_equals_pandas_and_does_not_leak(spark, method):
    values = poisson(900, 3).astype(float)
    df = pn.complete_panel(obs(spark, values, skip=set(range(300, 340))), P)
    got = frame(pn.add_rolling(df, P, method))
    y = got.departures.shift(1)
    for w in P.rolling_windows_hours:
        roll = y.rolling(w, min_periods=max(2, w // 4))
        np.testing.assert_allclose(got[f"roll_mean_{w}h"], roll.mean(), rtol=1e-9)
        np.testing.assert_allclose(got[f"roll_std_{w}h"], roll.std(), rtol=1e-7, atol=1e-7)


def test_changing_an_hour_does_not_change_its_own_features(spark):
    values = poisson(200)
    changed = values.copy()
    changed[150] = 500
    base, other = (frame(pn.add_rolling(pn.add_lags(pn.complete_panel(obs(spark, v), P), P), P)) for v in (values, changed))
    cols = P.lag_features + P.rolling_features
    pd.testing.assert_series_equal(base.loc[150, cols], other.loc[150, cols])
    assert not base.loc[151, cols].equals(other.loc[151, cols])


def _entities(spark):
    return spark.createDataFrame([("e", 40.7, -73.9, 30.0, 2), ("f", 40.8, -73.8, 20.0, 1)], "entity_id string, lat double, lon double, capacity double, n_stations long")


def test_training_and_scoring_windows_agree(spark):
    values = poisson(1008, 5)
    both = obs(spark, values).unionByName(obs(spark, poisson(1008, 6), "f"))
    target = T0 + timedelta(hours=1008)
    cut = T0 + timedelta(hours=1008 - P.history_hours)
    whole = frame(pn.feature_panel(both, _entities(spark), None, P, extra_hours=[target]))
    recent = frame(pn.feature_panel(both.where(F.col("hour_ts") >= F.lit(str(cut)).cast("timestamp_ntz")), _entities(spark), None, P, extra_hours=[target]))
    a, b = whole[whole.hour_ts == target].reset_index(drop=True), recent[recent.hour_ts == target].reset_index(drop=True)
    assert list(a.columns) == ["entity_id", "hour_ts", "departures", *P.features] and len(P.features) == 28
    for c in P.features:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, err_msg=c)


def test_sparse_entity_metadata(spark):
    sparse = spark.createDataFrame([("e", 40.7, -73.9)], "entity_id string, lat double, lon double")
    row = frame(pn.feature_panel(obs(spark, [1, 2, 3]), sparse, None, P)).iloc[0]
    assert pd.isna(row.capacity) and pd.isna(row.n_stations) and row.lat == 40.7 and pd.isna(row.temperature_c)


def test_contract_refuses_missing_features(spark):
    with pytest.raises(ValueError, match="lag_1h"):
        pn.to_contract(obs(spark, [1]), P)


def test_split_order_and_short_history(spark):
    panel = obs(spark, [1] * 800)
    parts = {r["split"]: r for r in ev.dataset_summary(ev.chronological_split(panel, P)).collect()}
    assert parts["train"]["last_hour"] < parts["validation"]["first_hour"] <= parts["validation"]["last_hour"] < parts["test"]["first_hour"]
    with pytest.raises(ValueError, match="too short"):
        ev.check_split(ev.chronological_split(obs(spark, [1] * 48), P), P)
    holey = obs(spark, [1] * 200).unionByName(obs(spark, [1] * 200, start=T0 + timedelta(days=60)))
    with pytest.raises(ValueError, match="gap"):
        ev.check_split(ev.chronological_split(holey, P), P)


def test_sequences_skip_unknown_hours(spark):
    df = pn.complete_panel(obs(spark, range(100), skip=set(range(40, 70))), P)
    got = pn.sequences(df, 10).orderBy("hour_ts").collect()
    hours = [int((r["hour_ts"] - T0).total_seconds() // 3600) for r in got]
    assert hours == [*range(10, 40), *range(80, 100)] and got[0]["sequence"] == [float(i) for i in range(10)]


def test_daylight_against_almanac(spark):
    days = {172: 15.05, 355: 9.25, 79: 12.12, 265: 12.15}
    df = spark.createDataFrame([(d,) for d in days], "d int")
    for r in df.select("d", daylight_hours(F.col("d"), 40.7306).alias("h"), daylight_hours(F.col("d"), 80.0).alias("pole")).collect():
        assert abs(r["h"] - days[r["d"]]) < 0.25 and 0 <= r["pole"] <= 24 and not math.isnan(r["pole"])


def test_daylight_flag(spark):
    hours = [datetime(2026, m, 21, h) for h in (19, 6, 13) for m in (6, 12)]
    out = add_seasonal(spark.createDataFrame([(i, h) for i, h in enumerate(hours)], "i int, hour_ts timestamp_ntz"), P).orderBy("i").collect()
    assert [r["is_daylight"] for r in out] == [1, 0, 1, 0, 1, 1]


def test_holidays(spark):
    known = {date(2026, 1, 1), date(2026, 1, 19), date(2026, 2, 16), date(2026, 5, 25), date(2026, 6, 19), date(2026, 7, 3), date(2026, 7, 4),
             date(2026, 9, 7), date(2026, 10, 12), date(2026, 11, 11), date(2026, 11, 26), date(2026, 12, 25)}
    dim = holiday_dim(spark, range(1990, 2035))
    assert {r["date"] for r in dim.where("year(date) = 2026").collect()} == known
    days = spark.sql("select explode(sequence(date'1990-01-01', date'2034-12-31')) as date")
    assert days.where(is_holiday(F.col("date"))).exceptAll(dim.select("date")).count() == 0
    assert dim.select("date").exceptAll(days.where(is_holiday(F.col("date")))).count() == 0


def test_entity_mapping(spark, tmp_path):
    rows = [(f"id{i}", f"{1000 + i}.01", 40.6 + 0.1 * (i // 4) + 0.001 * i, -74.0 + 0.1 * (i // 4), 20 + i) for i in range(12)]
    info = spark.createDataFrame(rows, "station_id string, short_name string, lat double, lon double, capacity int")
    p = P.but(n_clusters=3)
    mapping, entities = ent.fit_entities(info, None, p)
    pockets = {}
    for r in mapping.collect():
        pockets.setdefault(r["entity_id"], set()).add((int(r["station_short_name"][:4]) - 1000) // 4)
    assert len(pockets) == 3 and all(len(v) == 1 for v in pockets.values())
    assert entities.agg(F.sum("n_stations"), F.sum("capacity")).first()[:] == (12, 306.0)
    ent.save_mapping(mapping, entities, str(tmp_path / "m"), p)
    again, _ = ent.load_mapping(spark, str(tmp_path / "m"), p)
    assert again.exceptAll(mapping).count() == 0
    with pytest.raises(ValueError, match="granularity"):
        ent.load_mapping(spark, str(tmp_path / "m"), p.but(granularity="station"))
    with pytest.raises(ValueError, match="unsupported"):
        ent.fit_entities(info, None, P.but(granularity="block"))
    with pytest.raises(ValueError, match="no stations"):
        ent.fit_entities(info.limit(0), None, P)


def test_easter_sundays(spark):
    known = {1818: "03-22", 1943: "04-25", 1961: "04-02", 2000: "04-23", 2008: "03-23", 2011: "04-24", 2019: "04-21", 2024: "03-31", 2025: "04-20", 2026: "04-05", 2038: "04-25"}
    rows = spark.createDataFrame([(y,) for y in known], "y int").select("y", easter(F.col("y")).cast("string").alias("d")).collect()
    assert {r.y: r.d[5:] for r in rows} == known


# Public holidays as published by the countries' authorities.
PUBLISHED = {
    ("DE", 2024): "01-01 03-29 04-01 05-01 05-09 05-20 10-03 12-25 12-26",
    ("DE", 2017): "01-01 04-14 04-17 05-01 05-25 06-05 10-03 10-31 12-25 12-26",
    ("FR", 2024): "01-01 04-01 05-01 05-08 05-09 05-20 07-14 08-15 11-01 11-11 12-25",
    ("GB", 2020): "01-01 04-10 04-13 05-08 05-25 08-31 12-25 12-26 12-28",
    ("GB", 2021): "01-01 04-02 04-05 05-03 05-31 08-30 12-25 12-26 12-27 12-28",
    ("GB", 2022): "01-01 01-03 04-15 04-18 05-02 06-02 06-03 08-29 09-19 12-25 12-26 12-27",
    ("GB", 2023): "01-01 01-02 04-07 04-10 05-01 05-08 05-29 08-28 12-25 12-26",
    ("GB", 2024): "01-01 03-29 04-01 05-06 05-27 08-26 12-25 12-26",
}


@pytest.mark.parametrize("country", ["DE", "FR", "GB"])
def test_holidays_of_other_countries(spark, country):
    years = [y for c, y in PUBLISHED if c == country]
    found = holiday_dim(spark, years, country).select(F.col("date").cast("string").alias("d")).collect()
    assert sorted(r.d for r in found) == sorted(f"{y}-{d}" for y in years for d in PUBLISHED[country, y].split())
    days = spark.range(366 * 3).select(F.date_add(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    named = holiday_name(F.col("date"), country).isNotNull()
    assert days.where(is_holiday(F.col("date"), country) != named).isEmpty()


def test_unknown_country():
    for fn in (holiday_name, is_holiday):
        with pytest.raises(ValueError, match="XX"):
            fn(F.col("date"), "XX")
