"""Training set, candidate models and their evaluation."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from itertools import zip_longest

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.coerce import clip0
from demandspark.operators import boost
from demandspark.operators.entities import to_entities
from demandspark.operators.evaluate import check_split, chronological_split, naive_baseline, regression_metrics
from demandspark.operators.labels import select_labels
from demandspark.operators.panel import drop_warmup, feature_panel, known_target
from demandspark.params import Params

SERVED_GAP_WARNING = 0.05


def training_set(
    hourly: DataFrame, station_entity: DataFrame, entities: DataFrame, weather: DataFrame | None, params: Params
) -> DataFrame:
    """Labels to the split, model-ready panel: roll-up, panel, warm-up drop, known targets, split."""
    obs = to_entities(hourly, station_entity)
    # The first and last hour come from the roll-up, not from a panel built once more for each of them.
    hours = obs.where("departures is not null").select("hour_ts")
    panel = feature_panel(obs, entities, weather, params, bounds=hours)
    return chronological_split(known_target(drop_warmup(panel, params, hours)), params, hours)


def training_set_with_fallback(
    true: DataFrame, proxy: DataFrame, source: str, station_entity: DataFrame, entities: DataFrame,
    weather: DataFrame | None, params: Params,
) -> tuple[DataFrame, bool]:
    """``(training set, fell_back)``: an unusable label source is replaced by true labels, visibly."""
    labels = select_labels(true, proxy, source, params.retrain_window_days)
    data = training_set(labels, station_entity, entities, weather, params)
    try:
        check_split(data, params)
        return data, False
    except ValueError as problem:
        warnings.warn(f"labels {source!r} unusable ({problem}); training on true labels", stacklevel=2)
        data = training_set(select_labels(true, proxy, "offline"), station_entity, entities, weather, params)
        check_split(data, params)
        return data, True


def training_window(data: DataFrame) -> DataFrame:
    """One row ``(train_start, train_end)``: the first and last hour of the training split."""
    return data.where("split = 'train'").agg(F.min("hour_ts").alias("train_start"), F.max("hour_ts").alias("train_end"))


def usable_features(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one known training value (an all-NULL column cannot be imputed)."""
    row = train.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if row[c] > 0]


def _assembly(features: Sequence[str]) -> list:
    """Median imputation with a missing-value indicator per feature, then one vector."""
    filled, absent = [f"{c}__filled" for c in features], [f"{c}__absent" for c in features]
    flags = ", ".join(f"CAST(`{c}` IS NULL AS DOUBLE) AS `{a}`" for c, a in zip(features, absent, strict=True))
    return [
        SQLTransformer(statement=f"SELECT *, {flags} FROM __THIS__"),
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=[*filled, *absent], outputCol="inputs"),
    ]


def _fit(stages: list, train: DataFrame) -> PipelineModel:
    return Pipeline(stages=stages).fit(train)


def fit_poisson(train: DataFrame, valid: DataFrame, params: Params, **settings) -> PipelineModel:
    """Trees boosted on the Poisson deviance until the validation rows stop improving; see :mod:`boost`."""
    prepared = _fit(_assembly(usable_features(train, params.features)), train)
    found = boost.fit(prepared.transform(train), prepared.transform(valid), **{"seed": params.seed, **settings})
    link = SQLTransformer(statement=f"SELECT *, exp(margin + ({found.base!r})) AS raw FROM __THIS__")
    return PipelineModel(stages=[*prepared.stages, found.model, link])


def fit_linear(train: DataFrame, valid: DataFrame, params: Params) -> PipelineModel:
    """Generalised linear model with Poisson errors; the penalty is chosen by validation error."""
    features = usable_features(train, params.features)
    prepared = _fit(_assembly(features), train)
    tr = prepared.transform(train).select("inputs", "departures").cache()
    va = prepared.transform(valid).select("inputs", "departures").cache()
    fits = [
        GeneralizedLinearRegression(
            family="poisson", link="log", featuresCol="inputs", labelCol="departures", predictionCol="raw",
            regParam=penalty, maxIter=25,
        ).fit(tr)
        for penalty in (0.01, 1.0)
    ]
    errors = [regression_metrics(m.transform(va), "departures", "raw").first()["mae"] for m in fits]
    best = min(range(len(fits)), key=lambda i: errors[i])
    tr.unpersist(), va.unpersist()
    return PipelineModel(stages=[*prepared.stages, fits[best]])


def fit_boosted(train: DataFrame, valid: DataFrame, params: Params, max_iter: int = 40, depth: int = 5) -> PipelineModel:
    """Boosted trees on absolute error; boosting stops when the validation rows stop improving."""
    features = usable_features(train, params.features)
    marked = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    prepared = _fit(_assembly(features), train)
    model = GBTRegressor(
        lossType="absolute", validationIndicatorCol="_valid", featuresCol="inputs", labelCol="departures",
        predictionCol="raw", maxIter=max_iter, maxDepth=depth, stepSize=0.1, seed=params.seed,
    ).fit(prepared.transform(marked).select("inputs", "departures", "_valid"))
    return PipelineModel(stages=[*prepared.stages, model])


def fit_forest(train: DataFrame, valid: DataFrame, params: Params, trees: int = 30, depth: int = 8) -> PipelineModel:
    """Random forest as the second kind of candidate; same holdout and metric."""
    features = usable_features(train, params.features)
    forest = RandomForestRegressor(
        featuresCol="inputs", labelCol="departures", predictionCol="raw", numTrees=trees, maxDepth=depth, seed=params.seed
    )
    return _fit([*_assembly(features), forest], train)


CANDIDATES: dict[str, Callable[[DataFrame, DataFrame, Params], PipelineModel]] = {
    "poisson": fit_poisson, "linear": fit_linear, "boosted": fit_boosted, "forest": fit_forest,
}


def fit_candidates(data: DataFrame, params: Params, kinds: Sequence[str] = ("poisson", "boosted")) -> dict[str, PipelineModel]:
    """Fit every kind on the same split; one failing candidate does not fail the run."""
    train = data.where("split = 'train'").cache()
    valid = data.where("split = 'validation'").cache()
    fitted: dict[str, PipelineModel] = {}
    for kind in kinds:
        try:
            fitted[kind] = CANDIDATES[kind](train, valid, params)
        except Exception as problem:  # noqa: BLE001
            warnings.warn(f"candidate {kind!r} failed: {problem}", stacklevel=2)
    train.unpersist(), valid.unpersist()
    if not fitted:
        raise RuntimeError("no candidate could be trained")
    return fitted


def predict(model: Transformer, rows: DataFrame) -> DataFrame:
    """Input rows with ``predicted``, never below 0. Feature columns are cast to double first."""
    cast = rows.withColumns({c: F.col(c).cast("double") for c, t in rows.dtypes if t in ("int", "bigint", "float", "smallint", "tinyint")})
    return model.transform(cast).select(*rows.columns, clip0(F.col("raw")).alias("predicted"))


def evaluate(model: Transformer, split: DataFrame) -> DataFrame:
    """Metrics per split next to the same-hour-last-week baseline."""
    scored = predict(model, split.where("split in ('validation', 'test')"))
    return regression_metrics(scored, "departures", "predicted", ["split"]).join(naive_baseline(scored, ["split"]).drop("n"), "split", "left")


def as_served(spark: SparkSession, path: str, test: DataFrame, in_process_mae: float) -> DataFrame:
    """Metrics of the model reloaded from storage, and how far they are from the in-process ones."""
    reloaded = PipelineModel.load(path)
    metrics = regression_metrics(predict(reloaded, test), "departures", "predicted")
    gap = F.try_divide(F.col("mae") - F.lit(in_process_mae), F.lit(in_process_mae))
    return metrics.withColumns({"gap_ratio": gap, "suspicious": F.abs(gap) > SERVED_GAP_WARNING})


def importance(model: PipelineModel, k: int = 15) -> DataFrame:
    """``(feature, importance)``, the k largest; indicator columns count towards their feature."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = assembler.getInputCols()
    weights = next(s for s in reversed(model.stages) if hasattr(s, "featureImportances")).featureImportances.toArray()
    # The vector may end with the last feature that a tree uses.
    rows = [(n.rsplit("__", 1)[0], float(w)) for n, w in zip_longest(names, weights, fillvalue=0.0)]
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.groupBy("feature").agg(F.sum("importance").alias("importance")).orderBy(F.col("importance").desc(), "feature").limit(k)


def candidate_table(spark: SparkSession, results: Mapping[str, tuple[str, float, float, str]]) -> DataFrame:
    """``name -> (path, as-served MAE, in-process MAE, provenance)`` as the table :func:`promote.decide` reads."""
    rows = [(n, p, n, s, i, v) for n, (p, s, i, v) in results.items()]
    return spark.createDataFrame(
        rows, "name string, path string, kind string, mae double, score_in_process double, label_provenance string"
    )
