import json
import os
import time
from datetime import UTC, datetime, timedelta
from functools import reduce
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from demandspark.functions.times import utc_wall
from demandspark.operators import evaluate as ev
from demandspark.operators import monitor as mo
from demandspark.operators import proxy as px
from demandspark.params import Params
from demandspark.streaming import intervals as si
from demandspark.streaming import ordered as so
from demandspark.streaming import rederive as sr
from demandspark.streaming import snapshots as ss
from demandspark.streaming.matching import match_stream

P = Params(late_snapshot_delay="3 hours")
START = datetime(2026, 8, 1, 12)
SCHEMA = "station_id string, snapshot_ts timestamp, num_bikes_available int, is_renting int, is_installed int, last_reported timestamp"


def minutes(spark, station, first, last, step=1):
    rows = [
        (station, START + timedelta(minutes=m), 100 - (m * 7) % 13, 1, 1, START + timedelta(minutes=m)) for m in range(first, last, step)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def land(path, *parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)


def closing(spark):
    return minutes(spark, "closing", 60 * 24 * 3, 60 * 24 * 3 + 1)


def as_set(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_stream_equals_batch_under_disorder(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    # The middle hour arrives last but within the allowed delay, and one part arrives twice.
    parts = [minutes(spark, "a", 0, 60), minutes(spark, "a", 120, 180), minutes(spark, "a", 60, 120), minutes(spark, "a", 60, 90)]
    land(path, *parts, closing(spark))
    ss.run_available(si.stream_intervals(ss.table_stream(spark, path, SCHEMA, 1), P), out, f"{out}-state")
    names = ("station_id", "interval_end", "proxy_departures", "interval_minutes")
    batch = px.interval_departures(minutes(spark, "a", 0, 180), P)
    assert as_set(spark.read.parquet(out), *names) == as_set(batch, *names) and batch.count() == 179


def test_open_hour_is_withheld(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(path, minutes(spark, "a", 0, 60), minutes(spark, "a", 60, 120), minutes(spark, "a", 300, 330))
    ss.run_available(si.stream_intervals(ss.table_stream(spark, path, SCHEMA, 1), P), out, f"{out}-state")
    hours = {r["interval_end"].replace(minute=0) for r in spark.read.parquet(out).collect()}
    assert hours == {START, START + timedelta(hours=1)}


def test_slice_must_hold_a_gap(spark, tmp_path):
    land(str(tmp_path / "in"), minutes(spark, "a", 0, 2))
    with pytest.raises(ValueError, match="slice_minutes"):
        si.stream_intervals(ss.table_stream(spark, str(tmp_path / "in"), SCHEMA), P.but(max_gap_minutes=90.0))


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "Asia/Kolkata"])
@pytest.mark.parametrize("buckets", ["UTC", "Asia/Kolkata"])
def test_rederiving_corrects_late_data_and_replays_are_harmless(spark, tmp_path, monkeypatch, zone, buckets):
    """The driver's zone changes nothing, and hour buckets of a zone with half hours are derived whole."""
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        _rederive(spark, str(tmp_path / "t"), P.but(timezone=buckets))
    finally:
        monkeypatch.undo()
        time.tzset()


def _rederive(spark, base, p):
    info = spark.createDataFrame([("a", "s")], "station_id string, short_name string")
    process = sr.rederive_batch(f"{base}/snapshots", f"{base}/hourly", lambda s: info, p)
    batches = [minutes(spark, "a", 0, 60, 2), minutes(spark, "a", 60, 150), minutes(spark, "a", 1, 60, 2), minutes(spark, "a", 150, 200)]
    for i, batch in enumerate(batches):
        process(batch, i)
    process(batches[3], 3)
    process(batches[3].limit(0), 4)
    whole = minutes(spark, "a", 0, 200)
    expected = px.drop_open_hour(px.hourly_proxy(px.interval_departures(whole, p), info, p), px.newest_snapshot_hour(whole, p))
    names = ("station_short_name", "hour_ts", "departures", "n_intervals")
    got = sr.current_hours(spark.read.parquet(f"{base}/hourly"))
    assert as_set(got, *names) == as_set(expected, *names) and got.count() >= 2
    sr.compact(spark.read.parquet(f"{base}/hourly"), f"{base}/compacted")
    assert as_set(spark.read.parquet(f"{base}/compacted"), *names) == as_set(expected, *names)
    stamps = [r.t for r in whole.select(F.col("snapshot_ts").cast("string").alias("t")).orderBy("t").collect()]
    report = sr.expire_snapshots(spark, f"{base}/snapshots", stamps[-60], p.but(snapshot_retention_hours=0.0001))
    kept = spark.read.parquet(f"{base}/snapshots").select(F.col("snapshot_ts").cast("string").alias("t"))
    assert {r.t for r in kept.collect()} == set(stamps[-60:])
    assert sum(r.removed_rows for r in report.collect()) > 0


def test_replayed_snapshots_take_the_last_value(spark, tmp_path):
    base = str(tmp_path / "t")
    info = spark.createDataFrame([("a", "s")], "station_id string, short_name string")
    process = sr.rederive_batch(f"{base}/snapshots", f"{base}/hourly", lambda s: info, P)
    whole = minutes(spark, "a", 0, 130)
    process(whole.withColumn("num_bikes_available", F.lit(7)), 0)
    process(whole, 1)
    expected = px.drop_open_hour(px.hourly_proxy(px.interval_departures(whole, P), info, P), px.newest_snapshot_hour(whole, P))
    got = sr.current_hours(spark.read.parquet(f"{base}/hourly"))
    assert as_set(got, "hour_ts", "departures") == as_set(expected, "hour_ts", "departures")


def _log_of(spark, tmp_path, batches, p=P, info=None):
    base = str(tmp_path / "t")
    read = info or (lambda s: spark.createDataFrame([(x, f"s{x}") for x in "abcdef"], "station_id string, short_name string"))
    process = sr.rederive_batch(f"{base}/snapshots", f"{base}/hourly", read, p)
    for i, batch in enumerate(batches):
        process(batch, i)
    return spark.read.parquet(f"{base}/hourly")


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    """Six stations over ten hours; one late snapshot of one station then concerns two of its hours at most."""
    whole = reduce(lambda a, b: a.union(b), [minutes(spark, s, 0, 600, 2) for s in "abcdef"])
    late = minutes(spark, "c", 121, 122)
    log = _log_of(spark, tmp_path, [whole, late], P.but(derive_lookback_hours=24))
    written = log.where("batch = 1").select("station_short_name", "hour_ts").collect()
    assert {r.station_short_name for r in written} == {"sc"} and 1 <= len(written) <= 2
    # The first hour lacks its first interval and so is not covered; the last one is open.
    assert log.where("batch = 0 and departures is not null").count() == 6 * 8
    info = spark.createDataFrame([(x, f"s{x}") for x in "abcdef"], "station_id string, short_name string")
    all_rows = whole.union(late)
    expected = px.drop_open_hour(px.hourly_proxy(px.interval_departures(all_rows, P), info, P), px.newest_snapshot_hour(all_rows, P))
    names = ("station_short_name", "hour_ts", "departures", "n_intervals")
    assert as_set(sr.current_hours(log), *names) == as_set(expected, *names)


def test_a_wide_gap_is_derived_again_on_its_far_side(spark, tmp_path):
    """A late snapshot in the middle of a usable gap of hours changes the hour at the end of the gap."""
    p = P.but(max_gap_minutes=300.0, max_staleness_minutes=600.0, sample_spacing_seconds=3600.0)
    rows = minutes(spark, "a", 0, 1000, 240)
    late = minutes(spark, "a", 130, 131)
    log = _log_of(spark, tmp_path, [rows, late, minutes(spark, "b", 2000, 2001)], p)
    info = spark.createDataFrame([("a", "sa"), ("b", "sb")], "station_id string, short_name string")
    whole = rows.union(late).union(minutes(spark, "b", 2000, 2001))
    expected = px.drop_open_hour(px.hourly_proxy(px.interval_departures(whole, p.but(slice_minutes=600)), info, p), px.newest_snapshot_hour(whole, p))
    names = ("station_short_name", "hour_ts", "departures", "n_intervals")
    assert as_set(sr.current_hours(log), *names) == as_set(expected, *names) and expected.count() == 5


def test_an_hour_that_loses_its_cover_is_withdrawn(spark, tmp_path):
    closed = minutes(spark, "a", 0, 60).withColumn("is_renting", F.lit(0))
    batches = [minutes(spark, "a", 0, 180), closed]
    assert sr.current_hours(_log_of(spark, tmp_path, batches[:1])).count() == 2
    left = sr.current_hours(_log_of(spark, tmp_path / "again", batches))
    assert {r.hour_ts for r in left.collect()} == {START - timedelta(hours=4) + timedelta(hours=1)}


def test_renamed_stations_are_derived_over_the_look_back(spark, tmp_path):
    calls = []

    def info(s):
        calls.append(1)
        return spark.createDataFrame([("a", "sa"), *([("b", "sb")] if len(calls) > 1 else [])], "station_id string, short_name string")

    batches = [minutes(spark, "a", 0, 200).union(minutes(spark, "b", 0, 200)), minutes(spark, "a", 200, 201)]
    log = _log_of(spark, tmp_path, batches, P.but(derive_lookback_hours=24), info)
    assert log.where("batch = 0 and station_short_name = 'sb'").count() == 0
    assert log.where("batch = 1 and station_short_name = 'sb' and departures is not null").count() == 3


def test_expired_hours_are_left_alone(spark, tmp_path):
    base = str(tmp_path / "t")
    first = minutes(spark, "a", 0, 300)
    log = _log_of(spark, tmp_path, [first])
    before = as_set(sr.current_hours(log), "hour_ts", "departures")
    sr.expire_snapshots(spark, f"{base}/snapshots", START + timedelta(minutes=200), P.but(snapshot_retention_hours=0.001))
    process = sr.rederive_batch(f"{base}/snapshots", f"{base}/hourly", lambda s: spark.createDataFrame([("a", "sa")], "station_id string, short_name string"), P)
    process(minutes(spark, "a", 30, 31), 1)
    after = as_set(sr.current_hours(spark.read.parquet(f"{base}/hourly")), "hour_ts", "departures")
    assert after == before and len(after) == 4


def _match(spark, tmp_path, made, seen, delay="3 hours"):
    """The streams' output; later parts land as later files."""
    out = str(tmp_path / "out")
    for name, parts in (("made", made), ("seen", seen)):
        land(str(tmp_path / name), *parts)
    streams = [ss.table_stream(spark, str(tmp_path / n), p[0].schema, 1) for n, p in (("made", made), ("seen", seen))]
    smap = spark.createDataFrame([("s1", "x"), ("s2", "x"), ("s3", "y")], "station_short_name string, entity_id string")
    tally = ss.run_available(match_stream(*streams, smap, delay), out, f"{out}-state")
    rows = spark.read.parquet(out)
    return rows.withColumn("target_hour_ts", utc_wall(rows, "target_hour_ts")), smap, tally


def test_matched_stream_equals_batch_and_keeps_what_never_came(spark, tmp_path):
    hour = lambda h: datetime(2026, 8, 1) + timedelta(hours=h)
    made_schema = "entity_id string, target_hour_ts timestamp_ntz, predicted double, model_version string, predicted_at timestamp_ntz"
    seen_schema = "station_short_name string, hour_ts timestamp_ntz, departures long"
    predict = lambda hs, v, lead: spark.createDataFrame(
        [(e, hour(h), float(h + len(v)), v, hour(h - lead)) for h in hs for e in ("x", "y", "z")], made_schema
    )
    observe = lambda hs: spark.createDataFrame(
        [(s, hour(h), h + 1) for h in hs for s in ("s1", "s2", "s3", "unknown") if not (s == "s3" and h % 5 == 0)], seen_schema
    )
    # The second hour's demand comes last within the delay; the served version is made later but lands first.
    made = [predict(range(0, 20), "late", 1), predict(range(0, 30), "early", 2), predict([2000], "end", 1)]
    seen = [observe([0, 2, 3]), observe([1]), observe(range(4, 25)), observe([2000])]
    got, smap, tally = _match(spark, tmp_path, made, seen)
    ss.require_complete(tally)
    all_made = reduce(lambda a, b: a.union(b), made[:2])
    batch = ev.match_predictions(all_made, reduce(lambda a, b: a.union(b), seen[:3]), smap)
    names = ("entity_id", "target_hour_ts", "predicted", "model_version", "actual")
    assert as_set(got.where("actual is not null"), *names) == as_set(batch, *names) and batch.count() > 30
    # One row per predicted entity and hour in all, those without demand included.
    assert got.count() == got.select("entity_id", "target_hour_ts").distinct().count() == 30 * 3
    p = P.but(min_samples=5, timezone="UTC")
    known = got.where("actual is not null")
    assert mo.rolling_accuracy(known, hour(24), p).collect() == mo.rolling_accuracy(batch, hour(24), p).collect()


def test_state_of_the_match_ends_with_the_watermark(spark, tmp_path):
    """However long the streams, what is held is a horizon's worth of hours."""
    hour = lambda h: datetime(2026, 8, 1) + timedelta(hours=h)
    made = [spark.createDataFrame([("x", hour(h), 1.0, hour(h - 1)) for h in range(a, a + 24)], "entity_id string, target_hour_ts timestamp_ntz, predicted double, predicted_at timestamp_ntz") for a in range(0, 240, 24)]
    seen = [spark.createDataFrame([("s1", hour(h), 1) for h in range(a, a + 24)], "station_short_name string, hour_ts timestamp_ntz, departures long") for a in range(0, 240, 24)]
    got, _, tally = _match(spark, tmp_path, made, seen)
    assert got.count() >= 230 and ss.late_rows(tally) == 0
    # After each batch at most a landed day and the delay are still open, in each of the three states.
    assert tally.totals["state_rows"] <= tally.totals["batches"] * 4 * (24 + 3 + 1) * 2


def test_feed_stream_survives_broken_documents(spark, tmp_path):
    landing, out = tmp_path / "feed", str(tmp_path / "out")
    landing.mkdir()
    stamp = int(START.replace(tzinfo=UTC).timestamp())
    docs = [
        {"last_updated": stamp, "data": {"stations": [{"station_id": "a", "num_bikes_available": 5}, {"station_id": "b"}]}},
        {"data": {}},
        {"last_updated": stamp + 60, "data": {"stations": [{"station_id": "a", "num_bikes_available": 4}]}},
    ]
    for i, doc in enumerate(docs):
        (landing / f"{i}.json").write_text(json.dumps(doc))
    (landing / "9.json").write_text("not json at all")
    tally = ss.run_available(ss.snapshot_stream(spark, str(landing)), out, f"{out}-state")
    assert spark.read.parquet(out).count() == 2
    seen = ss.counters(tally)
    assert seen["entries"] == 3 and seen["empty_documents"] == 2 and seen["documents"] == 4 and seen["rejected_entries"] == 1


def test_rows_beyond_the_watermark_are_an_error(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    days = [minutes(spark, "a", 60 * 24 * d, 60 * 24 * d + 30) for d in range(3)]
    land(path, *days, minutes(spark, "a", 30, 40))
    tally = ss.run_available(si.stream_intervals(ss.table_stream(spark, path, SCHEMA, 1), P), out, f"{out}-state")
    assert ss.late_rows(tally) > 0
    with pytest.raises(RuntimeError, match="watermark"):
        ss.require_complete(tally)


def test_counts_of_more_batches_than_spark_remembers(spark, tmp_path):
    """The one late row comes in the fourth of 106 micro-batches; Spark's own list of reports has lost that one."""
    path, out = tmp_path / "in", str(tmp_path / "out")
    path.mkdir()
    hours = [0, 30, 60, 1, *range(61, 163)]
    for i, hour in enumerate(hours):
        (path / f"{i:03d}.json").write_text(json.dumps({"station_id": "a", "snapshot_ts": (START + timedelta(hours=hour)).isoformat()}))
        os.utime(path / f"{i:03d}.json", (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema("station_id string, snapshot_ts timestamp").option("maxFilesPerTrigger", 1).json(str(path))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tally = ss.run_available(ss.dedupe(stream, P), out, f"{out}-state")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert ss.counters(tally)["batches"] > 100 and ss.counters(tally)["rows"] == len(hours)
    assert ss.late_rows(tally) == 1 and spark.read.parquet(out).count() == len(hours) - 1
    with pytest.raises(RuntimeError, match="1 rows"):
        ss.require_complete(tally)


def test_a_batch_reported_twice_counts_once():
    report = lambda batch, rows: SimpleNamespace(batchId=batch, numInputRows=rows, observedMetrics={}, stateOperators=[])
    tally = ss.Tally()
    for batch, rows in ((0, 5), (1, 7), (1, 8), (2, 1)):
        tally.add(report(batch, rows))
    assert (tally.totals["rows"], tally.totals["batches"]) == (14, 3)


def test_ordered_state_equals_batch(spark, tmp_path):
    """Disorder, replays, a gap far wider than a slice, and one station with half of all rows."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    wide = P.but(max_gap_minutes=600.0, late_snapshot_delay="6 hours")
    hot = [minutes(spark, "hot", m, m + 60) for m in (0, 120, 60, 180)]
    few = [minutes(spark, f"s{k}", 0, 240, 20).where(F.minute("snapshot_ts") != 20) for k in range(20)]
    late = [minutes(spark, "gap", 0, 10), minutes(spark, "gap", 210, 240), minutes(spark, "hot", 90, 130)]
    parts = [hot[0], *few[:10], hot[1], hot[2], late[0], *few[10:], hot[3], late[1], late[2]]
    land(path, *parts, closing(spark))
    with so.state_store(spark):
        ss.require_complete(ss.run_available(so.ordered_intervals(ss.table_stream(spark, path, SCHEMA, 8), wide), out, f"{out}-state"))
    whole = reduce(lambda a, b: a.union(b), parts).distinct()
    batch = px.interval_departures(whole, wide.but(slice_minutes=1440))
    names = ("station_id", "interval_end", "proxy_departures", "interval_minutes")
    assert as_set(spark.read.parquet(out), *names) == as_set(batch, *names) and batch.count() > 400


class Store:
    """State and timers of one station, kept in memory."""

    def __init__(self):
        self.value, self.timers, self.watermark = None, set(), 0
        self.handle = SimpleNamespace(getValueState=lambda name, schema: self, registerTimer=self.timers.add)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_state_is_bounded_by_lateness():
    """A snapshot a minute, ten minutes of lateness: never more than eleven are held, and each leaves once, in order."""
    store, processor = Store(), so.Ordered()
    processor.init(store.handle)
    seen = []
    for m in range(300):
        at = (m ^ 3) * 60_000_000  # neighbours swapped
        row = {"at": at, "num_bikes_available": m, "is_renting": 1, "is_installed": None, "reported": None}
        store.watermark = max(0, m - 10) * 60_000
        seen += processor.handleInputRows(("a",), [row, row], store)
        assert len(store.value[1]) <= 14 and min(store.timers) is not None
    store.watermark = 10**9
    seen += processor.handleExpiredTimer(("a",), store, None)
    assert [r.at for r in seen] == [m * 60_000_000 for m in range(1, 300)]
    assert all(r.before.at == r.at - 60_000_000 for r in seen) and store.value[1] == []


def test_files_of_the_log_and_zone_lookups_do_not_grow_with_tasks_and_stations(spark, tmp_path):
    rows = reduce(lambda a, b: a.union(b), [minutes(spark, f"s{i}", 0, 60 * 24 * 3, 90) for i in range(12)])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        info = spark.createDataFrame([(f"s{i}", f"n{i}") for i in range(12)], "station_id string, short_name string")
        sr.rederive_batch(str(tmp_path / "log"), str(tmp_path / "hours"), lambda s: info, P)(rows, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    per_day = [len(list(day.glob("batch=0/*.parquet"))) for day in (tmp_path / "log").glob("day=*")]
    assert len(per_day) == 4 and set(per_day) == {1}
    plan = sr.touched_hours(rows, P)._jdf.queryExecution().optimizedPlan().toString()
    # The zone is asked below the join of half hours, so never on a row that names a station.
    asked = [line for line in plan.splitlines() if "convert_timezone" in line and "America/New_York" in line]
    assert asked and not any("station_id" in line for line in asked)


def test_micro_batches_by_bytes_take_many_small_files_at_once(spark, tmp_path):
    path = str(tmp_path / "in")
    land(path, *[minutes(spark, "a", m, m + 2) for m in range(0, 40, 2)])
    size = sum(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    for limit, batches in ((size + 1, 1), (size // 2, 2)):
        out = str(tmp_path / f"out{batches}")
        tally = ss.run_available(ss.table_stream(spark, path, SCHEMA, max_bytes=limit), out, f"{out}-state")
        assert tally.totals["rows"] == 40 and batches <= tally.totals["batches"] <= batches + 1
