"""Stations to entities: the frozen map, entity metadata and the roll-up."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.coerce import cluster_id
from demandspark.operators.keys import first_per_key, restrict
from demandspark.params import Params
from demandspark.session import settle

ENTITY_COLUMNS = ["entity_id", "lat", "lon", "capacity", "n_stations"]
RESTARTS = 10


def entity_metadata(stations: DataFrame) -> DataFrame:
    """Centre, total capacity and size per entity."""
    return stations.groupBy("entity_id").agg(
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.sum("capacity").cast("double").alias("capacity"),
        F.count("short_name").alias("n_stations"),
    )


def longitude_scale(stations: DataFrame) -> DataFrame:
    """One row: the factor that makes a degree of longitude as long as one of latitude."""
    return stations.agg(F.avg(F.cos(F.radians("lat"))).alias("lon_scale"))


def _eligible(stations: DataFrame, in_scope: DataFrame | None) -> DataFrame:
    frame = stations.dropna(subset=["short_name", "lat", "lon"])
    if in_scope is not None:
        frame = restrict(frame, in_scope, "short_name")
    frame = first_per_key(frame.select("short_name", "station_id", "lat", "lon", "capacity"), ["short_name"], ["station_id"])
    return frame.withColumn("capacity", F.coalesce(F.col("capacity").try_cast("double"), F.lit(0.0)))


def fit_entities(stations: DataFrame, in_scope: DataFrame | None, params: Params) -> tuple[DataFrame, DataFrame]:
    """``(station_entity, entities)``: identity per station, or k-means over scaled coordinates.

    ``in_scope`` carries ``short_name``. The result is meant to be saved and reused; cluster
    numbers depend on library and seed, so a map is never fitted again for scoring.
    """
    frame = settle(_eligible(stations, in_scope))
    n = frame.count()
    if n == 0:
        raise ValueError("no stations available to build an entity mapping")
    if params.granularity == "station":
        labelled = frame.withColumn("entity_id", F.col("short_name"))
    elif params.granularity == "cluster":
        scaled = frame.withColumn("scaled_lon", F.col("lon") * longitude_scale(frame).scalar())
        points = VectorAssembler(inputCols=["lat", "scaled_lon"], outputCol="point").transform(scaled).cache()
        k = min(params.n_clusters, n)
        if k == 1:
            labelled = frame.withColumn("entity_id", cluster_id(F.lit(0)))
        else:
            fits = [
                KMeans(k=k, seed=params.seed + i, featuresCol="point", predictionCol="label").fit(points)
                for i in range(RESTARTS)
            ]
            best = min(fits, key=lambda m: m.summary.trainingCost)
            labelled = settle(best.transform(points).select(*frame.columns, cluster_id("label").alias("entity_id")))
        points.unpersist()
    else:
        raise ValueError(f"unsupported granularity {params.granularity!r}")
    station_entity = labelled.select(F.col("short_name").alias("station_short_name"), "entity_id")
    return station_entity, entity_metadata(labelled).select(*ENTITY_COLUMNS)


def save_mapping(station_entity: DataFrame, entities: DataFrame, path: str, params: Params) -> None:
    """Freeze the map: two small tables carrying the granularity they were fitted for."""
    tag = F.lit(params.granularity).alias("granularity")
    station_entity.select("*", tag).write.mode("errorifexists").parquet(f"{path}/station_entity")
    entities.select("*", tag).write.mode("errorifexists").parquet(f"{path}/entities")


def load_mapping(spark: SparkSession, path: str, params: Params) -> tuple[DataFrame, DataFrame]:
    """Reload a frozen map; a map fitted for another granularity is refused."""
    frames = []
    for name in ("station_entity", "entities"):
        frame = spark.read.parquet(f"{path}/{name}")
        other = frame.where(F.col("granularity") != params.granularity).limit(1).count()
        if other:
            raise ValueError(f"mapping at {path} was not fitted for granularity {params.granularity!r}")
        frames.append(frame.drop("granularity"))
    return frames[0], frames[1]


def assign(hourly: DataFrame, station_entity: DataFrame) -> DataFrame:
    """Add ``entity_id``; NULL for unknown stations. No broadcast hint: the map grows with the network."""
    return hourly.join(station_entity.select("station_short_name", "entity_id"), "station_short_name", "left")


def to_entities(hourly: DataFrame, station_entity: DataFrame, unmapped: Observation | None = None) -> DataFrame:
    """Station-hours summed to ``(entity_id, hour_ts, departures)``; unmapped rows are dropped and counted."""
    assigned = assign(hourly, station_entity)
    if unmapped is not None:
        assigned = assigned.observe(unmapped, F.count(F.when(F.col("entity_id").isNull(), 1)).alias("unmapped_rows"))
    return assigned.where("entity_id is not null").groupBy("entity_id", "hour_ts").agg(
        F.sum("departures").cast("double").alias("departures")
    )


def unmapped_rows(hourly: DataFrame, station_entity: DataFrame) -> DataFrame:
    """One row: how many station-hours no entity knows, and how many there are."""
    return assign(hourly, station_entity).agg(
        F.count(F.when(F.col("entity_id").isNull(), 1)).alias("unmapped_rows"), F.count("*").alias("total_rows")
    )


def resolve_requests(requests: DataFrame, station_entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entity_id)`` to score and unknown ``(requested_id)``.

    ``requests`` has ``requested_id``, either an entity id or a station short name.
    """
    by_entity = station_entity.select(F.col("entity_id").alias("requested_id"), "entity_id").distinct()
    by_station = station_entity.select(F.col("station_short_name").alias("requested_id"), "entity_id")
    known = by_entity.union(by_station).distinct()
    wanted = requests.select("requested_id").distinct()
    entities = known.join(wanted, "requested_id", "left_semi").select("entity_id").distinct()
    return entities, wanted.join(known, "requested_id", "left_anti")
