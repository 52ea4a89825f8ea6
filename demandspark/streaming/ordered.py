"""Interval differences on the stream from ordered state per station.

A station's state is the last snapshot that was judged and the ones still open to late arrivals, in order. A snapshot is
judged once the watermark has passed it: no earlier one can come any more, so its predecessor is certain, however far
back it lies. A timer wakes the station when the watermark reaches its oldest open snapshot, whether or not new rows
arrive for it.

State per station is bounded by lateness times cadence: the snapshots of the last ``late_snapshot_delay`` and one more.
Replays within a batch or of an open snapshot add nothing. Unlike the slices of :mod:`intervals` there is no largest
gap to choose, but a Python worker is called per station and batch, so slices remain the faster way where the gap is
bounded. Needs the RocksDB state store, see :func:`state_store`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from demandspark.operators.proxy import judge_pairs
from demandspark.params import Params

#: A snapshot as it is kept; times are microseconds since the epoch, which no zone changes.
KEPT = {"at": "long", "num_bikes_available": "int", "is_renting": "int", "is_installed": "int", "reported": "long"}
SNAPSHOT = ", ".join(f"{n} {t}" for n, t in KEPT.items())
NESTED = "struct<" + ", ".join(f"{n}: {t}" for n, t in KEPT.items()) + ">"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Timers and typed state need the RocksDB store: queries started inside use it, later ones the store set before."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def merged(kept: list[tuple], new: Iterator[tuple], after: int | None) -> list[tuple]:
    """Open snapshots with new ones put in order; equal ones once, those not after the last judged time left out."""
    out = list(kept)
    for row in new:
        if after is not None and row[0] <= after:
            continue
        place = bisect_left(out, _order(row), key=_order)
        if place == len(out) or out[place] != row:
            out.insert(place, row)
    return out


def _order(row: tuple) -> tuple:
    """By time, then by values; unknown values come first."""
    return (row[0], *[(v is not None, v or 0) for v in row[1:]])


class Ordered(StatefulProcessor):
    """Emits every snapshot with its predecessor, in order, once the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("snapshots", f"last {NESTED}, open array<{NESTED}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last, kept = self._held()
        new = (tuple(row[n] for n in KEPT) for row in rows)
        return self._judge(key, last, merged(kept, new, last and last[0]), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self._judge(key, *self._held(), timerValues)

    def close(self) -> None:
        pass

    def _held(self) -> tuple[tuple | None, list[tuple]]:
        if not self.state.exists():
            return None, []
        last, kept = self.state.get()
        return last and tuple(last), [tuple(r) for r in kept]

    def _judge(self, key, last: tuple | None, kept: list[tuple], timers) -> Iterator[Row]:
        """Rows that lie before the watermark leave the state, each with the one before it."""
        closed = bisect_left(kept, timers.getCurrentWatermarkInMs() * 1000, key=lambda r: r[0])
        out = []
        for row in kept[:closed]:
            if last is not None:
                out.append(Row(station_id=key[0], **dict(zip(KEPT, row, strict=True)), before=Row(**dict(zip(KEPT, last, strict=True)))))
            last = row
        self.state.update((last, kept[closed:]))
        if kept[closed:]:
            self.handle.registerTimer(kept[closed][0] // 1000 + 1)
        return iter(out)


def ordered_pairs(stream: DataFrame, params: Params) -> DataFrame:
    """Every two consecutive snapshots of a station, judged as in a batch: ``interval_pairs`` of the whole stream."""
    micros = {"at": F.unix_micros("snapshot_ts"), "reported": F.unix_micros("last_reported")}
    known = stream.dropna(subset=["station_id", "snapshot_ts", "num_bikes_available"])
    flags = [F.col(c).cast("int").alias(c) for c in ("num_bikes_available", "is_renting", "is_installed")]
    rows = known.withWatermark("snapshot_ts", params.late_snapshot_delay).select("station_id", "snapshot_ts", *flags, *[c.alias(n) for n, c in micros.items()])
    linked = rows.groupBy("station_id").transformWithState(Ordered(), f"station_id string, {SNAPSHOT}, before {NESTED}", "append", "eventtime")
    names = ("num_bikes_available", "is_renting", "is_installed")
    previous = F.struct(F.timestamp_micros("before.at").alias("snapshot_ts"), *[F.col(f"before.{n}").alias(n) for n in names])
    pairs = linked.select(
        "station_id", F.timestamp_micros("at").alias("snapshot_ts"), *names,
        F.timestamp_micros("reported").alias("last_reported"), previous.alias("_prev"),
    )
    return judge_pairs(pairs, params, pairs.columns)


def ordered_intervals(stream: DataFrame, params: Params) -> DataFrame:
    """Streaming ``(station_id, interval_end, proxy_departures, interval_minutes)`` of usable pairs."""
    usable = ordered_pairs(stream, params).where("reject_reason is null")
    return usable.select("station_id", "interval_end", "proxy_departures", "interval_minutes")
