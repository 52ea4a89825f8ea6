"""Champion and challenger."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.stats import LOWER_IS_BETTER
from demandspark.params import Params
from demandspark.schemas import TABLES

PRODUCTION = "production"


def best_candidate(candidates: DataFrame, metric: str) -> DataFrame:
    """One row ``(challenger, challenger_score)``: lowest error or highest score, ties by name."""
    if metric not in candidates.columns:
        raise KeyError(f"candidates have no metric {metric!r}")
    score = F.col(metric).cast("double")
    checked = F.when(score.isNull(), F.raise_error(F.concat(F.lit(f"candidate without {metric}: "), F.col("name"))).cast("double")).otherwise(score)
    sign = 1.0 if metric in LOWER_IS_BETTER else -1.0
    scored = candidates.select("name", checked.alias("score"))
    row = F.struct("name", "score")
    best = scored.agg(F.min_by(row, F.struct((F.col("score") * sign).alias("s"), F.col("name").alias("n"))).alias("b"))
    return best.select(F.col("b.name").alias("challenger"), F.col("b.score").alias("challenger_score"))


def current_champion(registry: DataFrame) -> DataFrame:
    """Latest production row of the registry as one struct ``champion``; all fields NULL without one."""
    live = registry.where(F.col("stage") == PRODUCTION)
    return live.agg(F.max_by(F.struct(*registry.columns), F.col("version")).alias("champion"))


def relative_improvement(challenger: Column, champion: Column, metric: str) -> Column:
    """Positive is better; a champion at exactly 0 can only be tied or judged by sign."""
    gain = champion - challenger if metric in LOWER_IS_BETTER else challenger - champion
    at_zero = F.when(challenger == champion, 0.0).when(gain > 0, 1.0).otherwise(-1.0)
    return F.when(champion == 0, at_zero).otherwise(F.try_divide(gain, F.abs(champion)))


def decide(candidates: DataFrame, registry: DataFrame, params: Params, metric: str | None = None) -> DataFrame:
    """One row: ``promote, challenger, challenger_score, champion_score, improvement, reason`` (a code).

    Scores are compared as served on both sides. Without a champion the best candidate goes
    live; otherwise the gain must exceed the margin.
    """
    metric = metric or params.promotion_metric
    margin = params.min_relative_improvement
    row = best_candidate(candidates, metric).withColumn(
        "champion_score", current_champion(registry).select("champion.score_as_served").scalar()
    )
    row = row.withColumn("improvement", relative_improvement(F.col("challenger_score"), F.col("champion_score"), metric))
    clears = F.coalesce(F.col("improvement") > margin, F.lit(False))
    first = F.col("champion_score").isNull() & F.col("challenger").isNotNull()
    reason = (
        F.when(F.col("challenger").isNull(), "no_candidates")
        .when(first, "first_model")
        .when(clears, "gain_above_margin")
        .otherwise("gain_within_margin")
    )
    return row.select(
        (first | clears).alias("promote"), "challenger", "challenger_score", "champion_score", "improvement", reason.alias("reason")
    )


def record(
    decision: DataFrame, candidates: DataFrame, registry: DataFrame, params: Params, metric: str | None = None,
    window: DataFrame | None = None, mapping_path: str | None = None,
) -> DataFrame:
    """Registry row to append for a positive decision (no row otherwise); the newest production row is the live model.

    ``candidates`` also carries ``path``, ``kind``, ``score_in_process`` and ``label_provenance``; ``window`` is the one
    row ``(train_start, train_end)`` that monitoring later takes its reference rows from.
    """
    start, end = (
        (F.lit(None).cast("timestamp_ntz"),) * 2
        if window is None
        else (window.select("train_start").scalar(), window.select("train_end").scalar())
    )
    metric = metric or params.promotion_metric
    version = F.coalesce(registry.agg(F.max("version")).scalar(), F.lit(0)) + 1
    details = candidates.select(
        F.col("name").alias("challenger"), "path", "kind", F.col("score_in_process").cast("double"), "label_provenance"
    )
    return decision.where("promote").join(details, "challenger").select(
        version.cast("int").alias("version"),
        F.col("challenger").alias("model_name"),
        "path",
        "kind",
        "reason",
        F.lit(metric).alias("metric"),
        F.col("challenger_score").alias("score_as_served"),
        "score_in_process",
        "label_provenance",
        F.lit(PRODUCTION).alias("stage"),
        start.alias("train_start"),
        end.alias("train_end"),
        F.lit(params.granularity).alias("granularity"),
        F.lit(mapping_path).cast("string").alias("mapping_path"),
        F.lit(params.seed).cast("bigint").alias("seed"),
        F.current_timestamp().alias("recorded_at"),
    )


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False where it is there already. Of several callers one succeeds."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    if files.getUri().getScheme() == "file":
        # Hadoop's local file system looks first and creates then; the operating system does both at once.
        try:
            os.close(os.open(files.makeQualified(place).toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        files.create(place, False).close()
    except Py4JJavaError as failed:
        if not files.exists(place):
            raise failed
        return False
    return True


def claim_version(spark: SparkSession, root: str) -> int:
    """A version number that no one else holds: the next free one, claimed by creating its file.

    Claims are never given back, so numbers rise and a promotion that fails afterwards leaves a gap.
    """
    jvm = spark.sparkContext._jvm
    claims = jvm.org.apache.hadoop.fs.Path(f"{root}/claims")
    files = claims.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # One file per version ever promoted.
    held = [int(f.getPath().getName()) for f in files.listStatus(claims) if f.getPath().getName().isdigit()] if files.exists(claims) else []
    version = max(held, default=0) + 1
    while not _create(spark, f"{root}/claims/{version}"):
        version += 1
    return version


def publish(row: DataFrame, root: str) -> int | None:
    """Store the registry row of a positive decision under a version claimed for it; None for no row.

    Promotions may run at the same time: each gets a version of its own, and the highest one is live.
    """
    spark = row.sparkSession
    if row.isEmpty():
        return None
    version = claim_version(spark, root)
    numbered = row.withColumn("version", F.lit(version).cast("int")).select(*row.columns)
    numbered.coalesce(1).write.mode("errorifexists").parquet(f"{root}/rows/{version}")
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """All registry rows; none where nothing has been published."""
    try:
        return spark.read.schema(TABLES["model_registry"]).option("recursiveFileLookup", True).parquet(f"{root}/rows")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES["model_registry"])
