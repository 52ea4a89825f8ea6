"""Snapshot stream: landing folder to rows, replays removed, progress counted."""

from __future__ import annotations

from collections import Counter, defaultdict
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from demandspark.params import Params
from demandspark.functions.coerce import to_int
from demandspark.schemas import STATUS_FEED
from demandspark.sources.feeds import parse_station_status

COUNTERS = "ingest"
DOCUMENTS = ("documents", "empty_documents", "entries", "rejected_entries")


def snapshot_stream(spark: SparkSession, landing: str, max_files: int | None = None, one_per_file: bool = True) -> DataFrame:
    """Status documents landing as files (one per file, or one per line), parsed to snapshot rows as they arrive.

    The document is checked for its station list inside the plan, entries without id or count are
    skipped and counted, and neither ends the stream.
    """
    reader = spark.readStream.schema(STATUS_FEED).option("multiLine", one_per_file)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    docs = reader.json(landing)
    offered = F.coalesce(F.size("data.stations"), F.lit(0))
    broken = F.size(F.filter("data.stations", lambda s: s["station_id"].isNull() | to_int(s["num_bikes_available"]).isNull()))
    counted = docs.observe(
        COUNTERS, F.count("*").alias("documents"), F.count_if(offered <= 0).alias("empty_documents"), F.sum(offered).alias("entries"),
        F.sum(F.when(offered > 0, broken).otherwise(0)).alias("rejected_entries"),
    )
    return parse_station_status(counted.where(offered > 0))


def table_stream(
    spark: SparkSession, path: str, schema: str, max_files: int | None = None, pattern: str | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Snapshot rows landing as parquet files. A micro-batch takes at most ``max_files`` files or about ``max_bytes``.

    Each micro-batch has a cost of its own, so where files may be many and small, bytes are the better limit.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def dedupe(stream: DataFrame, params: Params) -> DataFrame:
    """Drop replays of the same station and time; state is kept only for the allowed lateness."""
    marked = stream.withWatermark("snapshot_ts", params.late_snapshot_delay)
    return marked.dropDuplicatesWithinWatermark(["station_id", "snapshot_ts"])


class Tally:
    """Sums over all micro-batches of a query. A batch that is reported again replaces its first report."""

    def __init__(self):
        self.batch, self.done, self.last = -1, Counter(), Counter()
        self.ended = Event()

    @property
    def totals(self) -> Counter:
        return self.done + self.last

    def add(self, progress) -> None:
        seen = progress.observedMetrics.get(COUNTERS)
        found = Counter(
            batches=1, rows=progress.numInputRows, dropped=sum(op.numRowsDroppedByWatermark for op in progress.stateOperators),
            state_rows=sum(op.numRowsTotal for op in progress.stateOperators),
            **{name: seen[name] or 0 for name in DOCUMENTS if seen is not None},
        )
        if progress.batchId > self.batch:
            self.done.update(self.last)
        self.batch, self.last = progress.batchId, found


class Listener(StreamingQueryListener):
    """Adds every progress report to the tally of its run, however many there are."""

    def __init__(self):
        self.tallies: defaultdict[str, Tally] = defaultdict(Tally)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.tallies[str(event.progress.runId)].add(event.progress)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tallies[str(event.runId)].ended.set()


def run(writer: DataStreamWriter, path: str | None = None, wait_seconds: float = 60.0) -> Tally:
    """Start a query, wait for its end, return the sums over all its progress reports.

    Reports arrive on a thread of their own, in order, so all are in once the query's end has been reported.
    """
    listener = Listener()
    manager = SparkSession.getActiveSession().streams
    manager.addListener(listener)
    try:
        query = writer.start(path) if path else writer.start()
        query.awaitTermination()
        tally = listener.tallies[str(query.runId)]
        if not tally.ended.wait(wait_seconds):
            raise RuntimeError("the end of the query was not reported, its counts may lack batches")
    finally:
        manager.removeListener(listener)
    return tally


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> Tally:
    """Process everything that has landed, write parquet, stop. The file sink is exactly-once."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    return run(writer.trigger(availableNow=True), path)


def late_rows(tally: Tally) -> int:
    """Rows that came after the watermark had passed them and were dropped, over all micro-batches."""
    return tally.totals["dropped"]


def require_complete(tally: Tally) -> Tally:
    """The tally, if no late row was dropped; results that lack rows are an error where they must equal a batch."""
    if dropped := late_rows(tally):
        raise RuntimeError(f"{dropped} rows came after the watermark; allow a longer late_snapshot_delay")
    return tally


def counters(tally: Tally) -> dict[str, int]:
    """Totals over all micro-batches: batches, input rows and the observed document counts."""
    return {name: tally.totals[name] for name in ("batches", "rows", *DOCUMENTS)}
