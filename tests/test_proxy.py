from datetime import datetime, timedelta

import pytest

from demandspark.operators import proxy as px
from demandspark.params import Params

P = Params()
START = datetime(2026, 8, 1, 12)
SCHEMA = "station_id string, snapshot_ts timestamp, num_bikes_available int, is_renting int, is_installed int, last_reported timestamp"
A = [20, 19, 18, 18, 16, 15, 15, 14, 13, 13, 12, 11, 10]
B = [10, 10, 11, 12, 12, 11, 11, 10, 10, 9, 9, 8, 8]


def snaps(spark, counts, station="a", gap=1.0, renting=None, installed=None, stale_minutes=0.0):
    rows = []
    for i, n in enumerate(counts):
        ts = START + timedelta(minutes=gap * i)
        rows.append(
            (station, ts, n, (renting or [1] * len(counts))[i], (installed or [1] * len(counts))[i], ts - timedelta(minutes=stale_minutes))
        )
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return [r["proxy_departures"] for r in df.orderBy("station_id", "interval_end").collect()]


def test_two_stations(spark):
    out = px.interval_departures(snaps(spark, A).unionByName(snaps(spark, B, "b")), P)
    a, b = values(out.where("station_id = 'a'")), values(out.where("station_id = 'b'"))
    assert len(a) == len(b) == 12 and sum(a) == 10.0 and min(b) == 0.0


def test_netting_and_cap(spark):
    assert values(px.interval_departures(snaps(spark, [20, 19]), P)) == [1.0]
    pairs = px.interval_pairs(snaps(spark, [20, 5]), P).collect()
    assert pairs[0]["proxy_departures"] == 10.0 and pairs[0]["capped"]


@pytest.mark.parametrize(
    ("kwargs", "reason"),
    [
        ({"renting": [1, 0, 1]}, "station_not_renting"),
        ({"installed": [1, 0, 1]}, "station_not_installed"),
        ({"stale_minutes": 360}, "stale_last_reported"),
        ({"gap": 180}, "implausible_interval_length"),
    ],
)
def test_rules(spark, kwargs, reason):
    pairs = px.interval_pairs(snaps(spark, [9, 8, 7], **kwargs), P)
    assert {r["reject_reason"]: r["n"] for r in px.reject_counts(pairs).collect()} == {reason: 2}


def test_rules_can_be_switched_off(spark):
    p = P.but(require_is_renting=False, require_is_installed=False)
    assert len(values(px.interval_departures(snaps(spark, [9, 8, 7], renting=[1, 0, 1], installed=[0, 0, 0]), p))) == 2


def test_optional_columns_may_be_absent(spark):
    bare = snaps(spark, [9, 8, 7]).select("station_id", "snapshot_ts", "num_bikes_available")
    assert values(px.interval_departures(bare, P)) == [1.0, 1.0]


def test_malformed_rows(spark):
    rows = [("a", "not-a-date", "5"), ("a", None, "4"), ("a", "2026-08-01 12:00:00", "abc"), (None, "2026-08-01 12:00:00", "3")]
    df = spark.createDataFrame(rows, "station_id string, snapshot_ts string, num_bikes_available string")
    assert px.interval_departures(df, P).count() == 0


def test_slices_do_not_change_the_result(spark):
    df = snaps(spark, A * 40, gap=2.0)
    one = values(px.interval_departures(df, P.but(slice_minutes=10_000)))
    assert one == values(px.interval_departures(df, P.but(slice_minutes=5))) and len(one) == len(A) * 40 - 1


def test_coverage_and_local_hour(spark):
    info = spark.createDataFrame([("a", "1000.01"), ("b", None)], "station_id string, short_name string")
    full = snaps(spark, [50 - i % 2 for i in range(51)])
    thin = snaps(spark, [50] * 11, "b")
    hourly = px.hourly_proxy(px.interval_departures(full.unionByName(thin), P), info, P).collect()
    assert [(r["station_short_name"], r["hour_ts"], r["n_intervals"]) for r in hourly] == [("1000.01", datetime(2026, 8, 1, 8), 50)]


def test_rederived_first_hour_is_complete(spark):
    """An upsert of the trailing window must not shrink the oldest hour."""
    info = spark.createDataFrame([("a", "s")], "station_id string, short_name string")
    df = snaps(spark, [100 - i % 7 for i in range(60 * 6)])
    everything = px.hourly_proxy(px.interval_departures(df, P), info, P)
    now = START + timedelta(hours=5, minutes=40)
    again = {r["hour_ts"]: r["departures"] for r in px.rederive(df, info, now, P).collect()}
    whole = {r["hour_ts"]: r["departures"] for r in everything.collect()}
    assert len(again) == 3 and all(whole[h] == v for h, v in again.items())


def test_quality_report(spark):
    row = px.proxy_quality(px.interval_departures(snaps(spark, A), P)).first()
    assert row["n_intervals"] == 12 and row["n_stations"] == 1 and row["mean_proxy_departures"] == pytest.approx(10 / 12)


def test_window_runs_over_slices_only(spark):
    plan = px.interval_pairs(snaps(spark, A), P)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("_slice" in line for line in windows)
