"""Writes: upsert, append, retention and packed feature rows, on partitioned parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from demandspark.functions.times import hours_before
from demandspark.operators.keys import latest_per_key
from demandspark.operators.monitor import utc_now
from demandspark.session import materialise


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], update: bool = True, order: Sequence[str] = ()
) -> DataFrame:
    """Existing rows with incoming ones merged in.

    On a key conflict only the columns that ``incoming`` supplies are overwritten; with
    ``update=False`` the stored row is kept. Keys repeated within the batch are reduced to the last one by ``order``,
    before the join, so a key repeated many times never meets the stored row more than once. Rows have no order of
    their own: without ``order`` the keys of the batch must be distinct, and the job fails if they are not.
    """
    supplied = [c for c in incoming.columns if c in existing.columns]
    batch = incoming.select(*dict.fromkeys([*supplied, *order]))
    if order:
        batch = latest_per_key(batch, keys, order).select(*supplied)
    else:
        rest = [c for c in supplied if c not in keys]
        once = F.when(F.count("*") > 1, F.raise_error(F.lit(f"keys {list(keys)} repeat in the batch and no order is given")))
        picked = batch.groupBy(*keys).agg(once.alias("_once"), *[F.first(c).alias(c) for c in rest])
        batch = picked.where(F.col("_once").isNull()).select(*supplied)
    if not update:
        return existing.unionByName(batch.join(existing.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
    new = batch.withColumn("_hit", F.lit(True)).withColumnsRenamed({c: f"_new_{c}" for c in supplied if c not in keys})
    merged = existing.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")
    columns = []
    for c in existing.columns:
        if c in supplied and c not in keys:
            columns.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(existing.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return merged.select(*columns)


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), sort: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write parquet; with partitions only the partitions present in ``df`` are replaced.

    Rows are ranged over partition and sort columns first: few files per partition, a large partition
    spread over many tasks, and narrow row-group statistics for later reads.
    """
    if partition or sort:
        df = df.repartitionByRange(*partition, *sort).sortWithinPartitions(*partition, *sort)
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic" if partition else "static")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append(df: DataFrame, path: str, day: str | None = None) -> None:
    """Append to a log; with ``day``, the name of its time column, partitioned by the calendar day of it."""
    if day is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def drop_partitions(spark: SparkSession, path: str, column: str, values: DataFrame) -> None:
    """Delete whole partitions of a stored table; ``values`` has one row per partition in its first column."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in values.distinct().toLocalIterator():
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{column}={row[0]}"), True)


def upsert_table(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition: Sequence[str], order: Sequence[str] = (),
    update: bool = True,
) -> None:
    """Merge a batch into a stored table that is partitioned by some of its keys.

    Only the partitions that the batch touches are read, merged and written back; all others keep their files. The
    merged rows go to the shared folder first, since a table cannot be overwritten while it is read and an executor
    lost in between must not cost stored rows. A table that does not exist yet is created.
    """
    batch = materialise(incoming, "batch")
    hit = batch.select(*partition).distinct()
    try:
        shown = spark.read.parquet(path).schema
        # Partition values are read as what the batch says they are, not as what they look like.
        known = [StructField(f.name, batch.schema[f.name].dataType) if f.name in partition else f for f in shown]
        stored = spark.read.schema(StructType(known)).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], batch.schema)
    # Values per column become one flat list each, so that the scan prunes by them; pairs of values that the batch does
    # not hold together are left out by the join.
    for c in partition:
        values = [r[0] for r in hit.select(c).distinct().toLocalIterator()]
        listed = F.col(c).isin([v for v in values if v is not None])
        stored = stored.where(listed | F.col(c).isNull() if None in values else listed)
    if len(partition) > 1:
        names = {c: f"_hit_{c}" for c in partition}
        pairs = hit.withColumnsRenamed(names)
        stored = stored.join(pairs, [stored[c].eqNullSafe(pairs[n]) for c, n in names.items()], "left_semi")
    merged = materialise(upsert(stored, batch, keys, update, order), "merged")
    write_table(merged, path, partition, [k for k in keys if k not in partition])


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def pack_features(df: DataFrame) -> DataFrame:
    """``(entity_id, hour_ts, payload)``: all other columns as one JSON object, NULLs kept as null."""
    names = [c for c in df.columns if c not in ("entity_id", "hour_ts")]
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c in names]
    return df.select("entity_id", "hour_ts", F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("payload"))


def retain(
    df: DataFrame, ts_col: str, now, days: float | None = None, hours: float | None = None, removed: Observation | None = None
) -> DataFrame:
    """Rows not older than the limit; hours win over days, and a limit of 0 or less keeps everything.

    ``removed`` observes ``removed_rows``, the number dropped.
    """
    limit = hours if hours is not None else (days * 24 if days is not None else 0)
    if limit <= 0:
        return df
    old = F.col(ts_col).cast("timestamp_ntz") < hours_before(utc_now(now), limit)
    if removed is not None:
        df = df.observe(removed, F.count_if(old).alias("removed_rows"))
    return df.where(~F.coalesce(old, F.lit(False)))


def prune_partitions(df: DataFrame, ts_col: str, now, hours: float) -> DataFrame:
    """One row per calendar day with the rows to keep and to drop: a day with nothing to keep can be
    dropped as a whole partition, and only the day of the cutoff is rewritten."""
    old = F.col(ts_col).cast("timestamp_ntz") < hours_before(utc_now(now), hours)
    return df.groupBy(F.to_date(ts_col).alias("day")).agg(
        F.count_if(~old).alias("kept_rows"), F.count_if(old).alias("removed_rows")
    )
