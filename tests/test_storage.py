from datetime import datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from demandspark.operators import entities as ent
from demandspark.params import Params
from demandspark.sinks import tables as sk
from demandspark.sources import tables as tbl

H = datetime(2026, 8, 1, 5)
KEYS = ["station_short_name", "hour_ts", "label_source"]
SCHEMA = "station_short_name string, hour_ts timestamp_ntz, label_source string, departures double, n_intervals int"


def rows(spark, *data):
    return spark.createDataFrame([(s, H, label, d, n) for s, label, d, n in data], SCHEMA)


def as_set(df):
    return {(r["station_short_name"], r["label_source"], r["departures"], r["n_intervals"]) for r in df.collect()}


def test_upsert(spark):
    old = rows(spark, ("a", "trip_csv", 1.0, 60), ("b", "trip_csv", 2.0, 60))
    new = rows(spark, ("a", "trip_csv", 5.0, 0), ("a", "gbfs_proxy", 7.0, 0)).drop("n_intervals")
    assert as_set(sk.upsert(old, new, KEYS)) == {("a", "trip_csv", 5.0, 60), ("b", "trip_csv", 2.0, 60), ("a", "gbfs_proxy", 7.0, None)}
    assert as_set(sk.upsert(old, new, KEYS, update=False)) == {("a", "trip_csv", 1.0, 60), ("b", "trip_csv", 2.0, 60), ("a", "gbfs_proxy", 7.0, None)}
    assert as_set(sk.upsert(old, new.limit(0), KEYS)) == as_set(old)


def test_repeated_keys_need_an_order(spark):
    batch = rows(spark, ("a", "x", 3.0, 1), ("a", "x", 2.0, 3))
    with pytest.raises(Exception, match="no order is given"):
        sk.upsert(rows(spark), batch, KEYS).collect()


def test_upsert_into_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "hourly")
    by = ["label_source"]
    sk.upsert_table(spark, path, rows(spark, ("a", "trip_csv", 1.0, 60), ("a", "gbfs_proxy", 2.0, 9)), KEYS, by)
    kept = sorted(p.name for p in (tmp_path / "hourly" / "label_source=trip_csv").glob("*.parquet"))
    sk.upsert_table(spark, path, rows(spark, ("a", "gbfs_proxy", 3.0, 8), ("b", "gbfs_proxy", 4.0, 7)), KEYS, by)
    sk.upsert_table(spark, path, rows(spark, ("b", "gbfs_proxy", 5.0, 1), ("b", "gbfs_proxy", 6.0, 2)), KEYS, by, order=["n_intervals"])
    sk.upsert_table(spark, path, rows(spark, ("b", "gbfs_proxy", 0.0, 0), ("c", "gbfs_proxy", 1.0, 1)), KEYS, by, update=False)
    want = {("a", "trip_csv", 1.0, 60), ("a", "gbfs_proxy", 3.0, 8), ("b", "gbfs_proxy", 6.0, 2), ("c", "gbfs_proxy", 1.0, 1)}
    assert as_set(spark.read.parquet(path)) == want
    assert sorted(p.name for p in (tmp_path / "hourly" / "label_source=trip_csv").glob("*.parquet")) == kept


def test_logs_are_stored_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    sk.append(rows(spark, ("a", "x", 1.0, 1)), path, "hour_ts")
    sk.append(rows(spark, ("a", "x", 1.0, 1)), path, "hour_ts")
    assert spark.read.parquet(path).count() == 2 and (tmp_path / "log" / "day=2026-08-01").is_dir()


def test_upsert_last_of_a_batch_wins(spark):
    batch = rows(spark, ("a", "x", 3.0, 1), ("a", "x", 2.0, 3), ("a", "x", 9.0, 2))
    assert as_set(sk.upsert(rows(spark), batch, KEYS, order=["n_intervals"])) == {("a", "x", 2.0, 3)}


def test_dynamic_overwrite_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "hourly")
    sk.write_table(rows(spark, ("a", "trip_csv", 1.0, 1), ("a", "gbfs_proxy", 2.0, 1)), path, ["label_source"], ["hour_ts"])
    sk.write_table(rows(spark, ("b", "gbfs_proxy", 3.0, 1)), path, ["label_source"], ["hour_ts"])
    stored = tbl.table(spark, path, "hourly_departures", ["station_short_name", "departures", "label_source"])
    assert {tuple(r) for r in stored.collect()} == {("a", 1.0, "trip_csv"), ("b", 3.0, "gbfs_proxy")}


def test_retention(spark):
    now = datetime(2026, 8, 5)
    df = spark.createDataFrame([(now - timedelta(hours=h),) for h in (1, 20, 80)], "ts timestamp_ntz")
    seen = Observation("removed")
    assert sk.retain(df, "ts", now, days=3, removed=seen).count() == 2 and seen.get["removed_rows"] == 1
    assert sk.retain(df, "ts", now, days=3, hours=12).count() == 1
    assert sk.retain(df, "ts", now, days=0).count() == 3 and sk.retain(df, "ts", now, days=3, hours=0).count() == 3


def test_features_roundtrip(spark):
    df = spark.createDataFrame([("e", H, 1.5, None), ("f", H, float("nan"), 2)], "entity_id string, hour_ts timestamp_ntz, a double, b int")
    packed = sk.pack_features(df).orderBy("entity_id").collect()
    assert packed[0]["payload"] == '{"a":1.5,"b":null}' and packed[1]["payload"] == '{"a":null,"b":2}'
    back = tbl.unpack_features(sk.pack_features(df), ["a", "b", "c"]).orderBy("entity_id").collect()
    assert [(r["a"], r["b"], r["c"]) for r in back] == [(1.5, None, None), (None, 2.0, None)]


def test_history_sources(spark):
    p = Params(timezone="UTC")
    hourly = spark.createDataFrame([("s", H, 2.0, "trip_csv"), ("s", H, 9.0, "gbfs_proxy")], "station_short_name string, hour_ts timestamp_ntz, departures double, label_source string")
    fresh = tbl.recent_history(hourly, None, H + timedelta(hours=6), p).collect()
    assert [(r["source"], r["departures"]) for r in fresh] == [("fresh", 2.0)]
    assert tbl.recent_history(hourly, None, H + timedelta(hours=7), p).first()["source"] == "stale"
    empty = hourly.where("departures < 0")
    assert tbl.recent_history(empty, hourly, H, p).first()["source"] == "fallback"
    assert tbl.history_source(tbl.recent_history(empty, None, H, p)).first()["source"] == "none"


def test_unmapped_rows_are_counted(spark):
    hourly = spark.createDataFrame([("a", H, 1.0), ("z", H, 2.0)], "station_short_name string, hour_ts timestamp_ntz, departures double")
    mapping = spark.createDataFrame([("a", "e")], "station_short_name string, entity_id string")
    seen = Observation("unmapped")
    assert ent.to_entities(hourly, mapping, seen).count() == 1 and seen.get["unmapped_rows"] == 1


def test_table_reads_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    sk.write_table(rows(spark, ("a", "trip_csv", 1.0, 1)), path, ["label_source"], ["hour_ts"])
    df = tbl.table(spark, path, "hourly_departures", ["station_short_name"], "hour_ts", start=H).where(F.lit(True))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hour_ts" in plan and "departures" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("n", [1, 2])
def test_newest(spark, n):
    df = spark.createDataFrame([(H, 1), (H + timedelta(hours=1), 2)], "computed_at timestamp_ntz, v int")
    assert [r["v"] for r in tbl.newest(df, n).collect()] == [2, 1][:n]
