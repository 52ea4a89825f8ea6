import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from demandspark.functions.coerce import clip0, safe_ratio, to_celsius, to_flag, to_int, wind_kmh
from demandspark.operators import labels as lb
from demandspark.params import Params
from demandspark.schemas import INFO_FEED, STATUS_FEED
from demandspark.sources import feeds, tables, trips
from demandspark.sources import weather as wx


@pytest.mark.parametrize(
    "header",
    [
        ["ride_id", "started_at", "start_station_id"],
        ["tripduration", "starttime", "start station id"],
        ["Trip Duration", "Start Time", "Start Station ID"],
        ["from_station_id", "start_time"],
    ],
)
def test_header_generations(header):
    found = trips.resolve_columns(header)
    assert found["start_time_raw"] is not None and found["station_raw"] is not None


def test_unknown_header():
    with pytest.raises(ValueError, match="unrecognised"):
        trips.resolve_columns(["foo", "started_at"])


def test_csv_files_of_several_generations(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ride_id,started_at,start_station_id\nx,2026-06-01 08:14:00,5506.10\n"y, z",2026-06-01 08:59:59.999,5506.1\nw,1,2,3,4\nu,2026-06-01 08:20:00\n')
    (tmp_path / "b.csv").write_text("Start Time,Start Station ID\n6/1/2026 9:00:00, 5506.14\n6/1/2026 9:01,5506.14 \nbad,7\n,7\n2026-06-01 09:00:00,\n")
    (tmp_path / "c.csv").write_text("foo,bar\n1,2\n")
    found, rejects = trips.read_trips(spark, [str(tmp_path)])
    rows = {(r["station_short_name"], r["hour_ts"]): r["departures"] for r in lb.hourly_counts(lb.clean_trips(found)).collect()}
    eight, nine = datetime(2026, 6, 1, 8), datetime(2026, 6, 1, 9)
    assert rows == {("5506.10", eight): 1, ("5506.1", eight): 1, ("5506.14", nine): 2}
    assert [r["file"].rsplit("/", 1)[1] for r in rejects.collect()] == ["c.csv"]


def test_headers_take_one_job_for_any_number_of_files(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.csv").write_text(("started_at,start_station_id\n" if i % 2 else "starttime,start station id\n") + "2026-06-01 08:00:00,x\n" * i)
    (tmp_path / "mark.csv").write_text("\ufeffstarted_at,start_station_id\n")
    groups = trips.headers(spark, [str(tmp_path)])
    assert {k: len(v) for k, v in groups.items()} == {("started_at", "start_station_id"): 7, ("starttime", "start station id"): 6}
    found, rejects = trips.read_trips(spark, [str(tmp_path)])
    assert len(found.collect()) == sum(range(12)) and rejects.count() == 0


def test_coercions(spark):
    ints = spark.createDataFrame([("5",), ("7",), ("3.0",), (None,), ("abc",), ("[]",)], "x string").select(to_int(F.col("x")).alias("v"))
    assert [r["v"] for r in ints.collect()] == [5, 7, 3, None, None, None]
    words = ["true", "false", "1", "0", "yes", "no", None, "?", "2"]
    flags = spark.createDataFrame([(w,) for w in words], "x string").select(to_flag(F.col("x")).alias("v"))
    assert [r["v"] for r in flags.collect()] == [1, 0, 1, 0, 1, 0, 0, 0, 1]


def test_small_functions(spark):
    row = spark.range(1).select(
        wind_kmh(F.lit("10 to 15 mph")).alias("w"), wind_kmh(F.lit("calm")).alias("c"), to_celsius(F.lit(212.0), F.lit("F")).alias("t"),
        clip0(F.lit(None).cast("double")).alias("n"), clip0(F.lit(-2.0)).alias("z"), safe_ratio(F.lit(1.0), F.lit(0.0)).alias("r"),
    ).first()
    assert row["w"] == pytest.approx(20.1168) and row["c"] is None and row["t"] == 100.0
    assert row["n"] is None and row["z"] == 0.0 and row["r"] == 0.0


def _feed(spark, text, schema):
    return spark.createDataFrame([(text,)], "doc string").select(F.from_json("doc", schema).alias("f")).select("f.*")


def test_information_feed(spark):
    doc = """{"data": {"stations": [
        {"station_id": "good", "short_name": " 1.0 ", "lat": 40.7, "lon": -73.9},
        {"station_id": "zero", "lat": 0.0, "lon": 0.0}, {"station_id": "text", "lat": "x", "lon": 1},
        {"lat": 40.7, "lon": -73.9}, {"station_id": "no-lon", "lat": 40.7}]}}"""
    rows = feeds.parse_station_info(_feed(spark, doc, INFO_FEED)).collect()
    assert [(r["station_id"], r["short_name"], r["capacity"]) for r in rows] == [("good", "1.0", 0)]


def test_status_feed(spark):
    doc = """{"last_updated": 1785585600, "data": {"stations": [
        {"station_id": "a", "num_bikes_available": "4", "is_renting": true, "last_reported": 0},
        {"station_id": "", "num_bikes_available": 4}, {"station_id": "b"}, {"station_id": "c", "num_bikes_available": "x"}]}}"""
    rows = feeds.parse_station_status(_feed(spark, doc, STATUS_FEED)).collect()
    assert len(rows) == 1 and rows[0]["num_bikes_available"] == 4 and rows[0]["is_renting"] == 1 and rows[0]["is_installed"] == 0
    assert rows[0]["last_reported"] is None and rows[0]["num_docks_available"] == 0


@pytest.mark.parametrize("doc", ['{"data": {}}', '{"data": {"stations": "none"}}', "{}"])
def test_feed_without_station_list_fails(spark, doc):
    with pytest.raises(Exception, match="no data.stations list"):
        feeds.parse_station_status(_feed(spark, doc, STATUS_FEED)).collect()


def test_weather_combination(spark):
    schema = "hour_ts timestamp_ntz, temperature_c double, precipitation_mm double, wind_speed_kmh double"
    h = [datetime(2026, 1, 1, i) for i in range(3)]
    a = spark.createDataFrame([(h[0], 1.0, 0.0, 0.0), (h[1], 2.0, 0.0, 0.0)], schema)
    b = spark.createDataFrame([(h[1], 9.0, 0.0, 0.0), (h[2], 3.0, 0.0, 0.0)], schema)
    first = {r["hour_ts"]: r["temperature_c"] for r in wx.combine_weather([a, b]).collect()}
    last = {r["hour_ts"]: r["temperature_c"] for r in wx.combine_weather([a, b], last_wins=True).collect()}
    assert first[h[1]] == 2.0 and last[h[1]] == 9.0 and len(first) == len(last) == 3
    assert wx.live_weather(a, b).count() == 2 and wx.live_weather(a.limit(0), b).count() == 2


def test_labels(spark):
    schema = "station_short_name string, hour_ts timestamp_ntz, departures double"
    h = datetime(2026, 1, 1)
    true, proxy = spark.createDataFrame([("s", h, 5.0)], schema), spark.createDataFrame([("s", h, 2.0), ("t", h, 3.0)], schema)
    blend = {r["station_short_name"]: (r["departures"], r["label_source"]) for r in lb.select_labels(true, proxy, "blend").collect()}
    assert blend == {"s": (5.0, "trip_csv"), "t": (3.0, "gbfs_proxy")}
    assert lb.select_labels(true, proxy, "offline").count() == 1 and lb.select_labels(true, proxy, "live").count() == 2
    with pytest.raises(ValueError):
        lb.select_labels(true, proxy, "other")


class Counted:
    """A local file system whose streams note how many bytes were read."""

    def __init__(self):
        self.seen = []

    def open_input_stream(self, place, **options):
        self.stream = trips.pafs.LocalFileSystem().open_input_stream(place, **options)
        return self

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()

    def read(self, n):
        self.seen.append(n)
        return self.stream.read(n)


def test_headers_read_one_block_whatever_the_size(tmp_path, monkeypatch):
    """Bytes read for a header do not depend on the size of the file."""
    for rows in (10, 200_000):
        path = tmp_path / f"{rows}.csv"
        path.write_text("started_at,start_station_id\n" + "2026-06-01 08:00:00,x\n" * rows)
        files = Counted()
        monkeypatch.setattr(trips, "_opener", lambda p, files=files: (files, p))
        assert trips.first_line(str(path)) == b"started_at,start_station_id"
        assert sum(files.seen) == trips.HEADER_BLOCK


def test_headers_of_awkward_files(spark, tmp_path):
    wide = ",".join(f"column_{i}" for i in range(5000))
    (tmp_path / "wide.csv").write_text(wide + "\nx\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("started_at,start_station_id")
    (tmp_path / "old mac #1.csv").write_text("starttime,start station id\r\n2026-06-01 08:00:00,x\r\n")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as f:
        f.write("starttime,start station id\n" + "2026-06-01 08:00:00,x\n" * 1000)
    found = trips.list_files(spark, [str(tmp_path)])
    assert trips._readable(found)
    by_block = trips.headers(spark, [str(tmp_path)])
    names = {k[0]: sorted(p.rsplit("/", 1)[1] for p in v) for k, v in by_block.items()}
    assert names == {"column_0": ["wide.csv"], "started_at": ["bare.csv"], "starttime": ["old mac #1.csv", "packed.csv.gz"]}
    by_scan = {r.path: r.header for r in trips._headers_by_scan(spark, [str(tmp_path)], "*.csv*", found).collect()}
    assert {r.path: r.header for r in trips._headers_by_block(found).collect()} == {p: h or "" for p, h in by_scan.items()}
    rows, _ = trips.read_trips(spark, [str(tmp_path)])
    assert rows.where("station_raw = 'x'").count() == 1001


def test_unknown_store_is_scanned(spark):
    paths = spark.createDataFrame([("nosuch://host/a.csv",)], "path string")
    assert not trips._readable(paths)


HOURLY = "station_short_name string, hour_ts timestamp_ntz, departures bigint"


def test_months_that_are_missing(spark, tmp_path):
    rows = [("a", datetime(2026, m, 1, 8), 60) for m in (1, 2, 3)]
    tables.cache_month(spark.createDataFrame(rows, HOURLY), str(tmp_path / "m"))
    stored = tables.cached_month(spark, str(tmp_path / "m"))
    two = tables.load_hourly(stored, ["202601", "202603"], None, Params())
    assert {r.hour_ts.month for r in two.collect()} == {1, 3}
    with pytest.warns(UserWarning, match="202604"):
        assert tables.load_hourly(stored, ["202602", "202604"], None, Params()).count() == 1
    with pytest.raises(ValueError, match="202505"):
        tables.load_hourly(stored, ["202505", "202504"], None, Params())


def test_a_file_replaces_its_own_part_only(spark, tmp_path):
    path = str(tmp_path / "parts")

    def counts(file, *rows):
        return spark.createDataFrame([(file, s, h, n) for s, h, n in rows], f"file string, {HOURLY}")

    eight, march = datetime(2026, 2, 1, 8), datetime(2026, 3, 1, 8)
    tables.store_parts(counts("x", ("a", eight, 5), ("a", march, 7)).unionByName(counts("y", ("a", eight, 1))), path)

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "parts").rglob("*.parquet")}

    def total():
        return {(r.station_short_name, r.hour_ts): r.departures for r in lb.merge_hourly([tables.stored_parts(spark, path)]).collect()}

    before = files()
    assert total() == {("a", eight): 6, ("a", march): 7}
    tables.store_parts(counts("x", ("a", eight, 2)), path)  # corrected: the march hour was wrong
    assert total() == {("a", eight): 3}
    assert len([p for p, t in files().items() if before.get(p) == t]) == 1
    tables.drop_part(spark, path, "y")
    assert total() == {("a", eight): 2}


def test_label_window(spark):
    true = spark.createDataFrame([("a", datetime(2026, 1, 1), 9)], HOURLY)
    proxy = spark.createDataFrame([("a", datetime(2026, 1, 1), 1), ("a", datetime(2026, 3, 1), 2), ("a", datetime(2026, 3, 31), 3)], HOURLY)
    found = {(r.hour_ts.month, r.hour_ts.day): r.departures for r in lb.select_labels(true, proxy, "blend", 60).collect()}
    assert found == {(1, 1): 9, (3, 1): 2, (3, 31): 3}
    assert {r.departures for r in lb.select_labels(true, proxy, "live", 10).collect()} == {3}
    assert lb.select_labels(true, proxy, "live").count() == 3


def test_sums_of_counts_are_dealt_into_tasks_of_their_own(spark):
    """Adaptive execution may put all counts into one task; the sums over them must not join them there."""
    rows = [(f"s{i % 7}", datetime(2024, 1, 1 + i % 3, i % 24, i % 60)) for i in range(400)]
    hourly = lb.hourly_counts(spark.createDataFrame(rows, "station_short_name string, start_time timestamp_ntz"))
    out = tables.latest_window(hourly, 30)
    got = {(r.station_short_name, r.hour_ts): r.departures for r in out.collect()}
    counts = {(r.station_short_name, r.hour_ts): float(r.departures) for r in hourly.collect()}
    newest = max(hour for _, hour in counts)
    assert got == {k: n for k, n in counts.items() if (newest - k[1]).total_seconds() <= 30 * 3600}
    # Spark leaves out a step that deals rows as they lie already.
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
