"""Trip records in CSV files whose headers changed over the years."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Known header names per field, in order of preference.
ALIASES = {
    "start_time_raw": ("started_at", "starttime", "start_time"),
    "station_raw": ("start_station_id", "start_station", "from_station_id"),
    "lat": ("start_lat", "start_station_latitude"),
    "lon": ("start_lng", "start_lon", "start_station_longitude"),
    "name": ("start_station_name", "from_station_name"),
}
REQUIRED = ("start_time_raw", "station_raw")
TRIPS_SCHEMA = "start_time_raw string, station_raw string, lat string, lon string, name string, file string"
REJECTS_SCHEMA = "file string, header string, reason string"
_COMMA_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _words(name: str) -> tuple[str, ...]:
    """A column name by its words alone, so that case, spaces and underscores do not tell names apart."""
    return tuple(re.findall("[a-z0-9]+", name.lower()))


def resolve_columns(columns: Sequence[str]) -> dict[str, int | None]:
    """Field to column position; raises when a required field has no known name."""
    at = {_words(c): i for i, c in enumerate(columns)}
    found = {field: next((at[n] for n in map(_words, names) if n in at), None) for field, names in ALIASES.items()}
    lacking = [f for f in REQUIRED if found[f] is None]
    if lacking:
        raise ValueError(f"unrecognised trip header, no column for {lacking} among {sorted(columns)}")
    return found


def list_files(spark: SparkSession, paths: Sequence[str], pattern: str = "*.csv*") -> DataFrame:
    """``(path, file)`` of the files under the paths, as given to a reader and as shown by its metadata; contents are
    not read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return listing.load(list(paths)).select("path", F.col("_metadata.file_path").alias("file"))


#: Bytes of a file that are read at a time while its first line has not ended.
HEADER_BLOCK = 1 << 13


def _opener(path: str):
    """``(file system, path on it)`` for a path as Spark lists it; raises where pyarrow does not know the scheme."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    return (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(path)


def first_line(path: str) -> bytes:
    """The first line of a file without its end, unpacked if its name says that it is packed; blocks are read until the
    line ends, whatever the size of the file."""
    files, place = _opener(path)
    held = b""
    with files.open_input_stream(place, compression="detect", buffer_size=HEADER_BLOCK) as stream:
        while not (end := re.search(rb"[\r\n]", held)):
            block = stream.read(HEADER_BLOCK)
            if not block:
                return held
            held += block
    return held[: end.start()]


def _readable(paths: DataFrame) -> bool:
    """Whether pyarrow opens the schemes of all paths (at most a few)."""
    schemes = paths.select(F.regexp_extract("path", r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)", 1).alias("scheme")).distinct()
    try:
        for row in schemes.collect():
            _opener(f"{row.scheme}/")
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _headers_by_block(found: DataFrame) -> DataFrame:
    """``(path, header)`` from the first block of each file, dealt over all tasks by path."""

    def run(batches):
        for batch in batches:
            paths = batch.column(0)
            lines = [first_line(p).decode("utf-8", "replace") for p in paths.to_pylist()]
            yield pa.RecordBatch.from_arrays([paths, pa.array(lines, pa.string())], ["path", "header"])

    return found.select("path").repartition("path").mapInArrow(run, "path string, header string")


def _headers_by_scan(spark: SparkSession, paths: Sequence[str], pattern: str, found: DataFrame) -> DataFrame:
    """The same for stores that only Spark's readers open, by a scan of all lines of which one per file is left in every
    task."""
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(list(paths))
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # Ids rise in the order of the lines within a task.
    opening = lines.where("start = 0").withColumn("nth", F.monotonically_increasing_id())
    first = opening.groupBy("file").agg(F.min_by("value", "nth").alias("header"))
    return found.join(first, "file", "left").select("path", "header")


def headers(spark: SparkSession, paths: Sequence[str], pattern: str = "*.csv*") -> dict[tuple[str, ...], list[str]]:
    """Files by their first line; files of no bytes have none and are left out.

    Of each file only its first block is read, by the executors. What comes to the driver is the file names, which a
    scan of them keeps there anyway.
    """
    found = list_files(spark, paths, pattern)
    lines = _headers_by_block(found) if _readable(found) else _headers_by_scan(spark, paths, pattern, found)
    by_header = lines.groupBy(F.coalesce("header", F.lit("")).alias("header")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in by_header.orderBy("header").toLocalIterator():
        names = re.split(_COMMA_OUTSIDE_QUOTES, row.header.lstrip("\ufeff"))
        groups.setdefault(tuple(c.strip().strip('"') for c in names), []).extend(row.paths)
    return groups


def _read_group(spark: SparkSession, header: Sequence[str], files: list[str], fields: dict[str, int | None]) -> DataFrame:
    names = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{n} string" for n in names) + ", broken string"
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "broken")
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(files)
    )
    # A line with surplus fields is bad; one with missing fields is read as far as it goes.
    surplus = F.size(F.split("broken", _COMMA_OUTSIDE_QUOTES)) > len(header)
    raw = raw.where(F.col("broken").isNull() | ~surplus)
    picked = [(F.col(names[i]) if i is not None else F.lit(None).cast("string")).alias(f) for f, i in fields.items()]
    return raw.select(*picked, F.col("_metadata.file_path").alias("file"))


def read_trips(spark: SparkSession, paths: Sequence[str], pattern: str = "*.csv*") -> tuple[DataFrame, DataFrame]:
    """``(trips, rejects)``: all values as text, files grouped by header, unknown headers rejected as files.

    Station ids stay text: ``5506.10`` and ``5506.1`` are different stations.
    """
    groups = headers(spark, paths, pattern)
    parts, rejects = [], []
    for header, members in groups.items():
        try:
            parts.append(_read_group(spark, header, members, resolve_columns(header)))
        except ValueError as problem:
            rejects += [(f, ",".join(header), str(problem)) for f in members]
    trips = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], TRIPS_SCHEMA)
    return trips, spark.createDataFrame(rejects, REJECTS_SCHEMA)
