"""Gradient boosting on the Poisson deviance with a log link.

A round takes the current mean ``m`` of every row and fits Spark's regression tree to the working response ``(y - m) / m``
with weight ``m``. A leaf's weighted average is then sum(y - m) / sum(m), the Newton step of the deviance in that leaf, and
the tree's variance gain is the gain of that step. Steps are shortened by the learning rate, and halved while the training
deviance would rise. The validation deviance of every round decides where boosting ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.session import materialise


@dataclass
class Boosted:
    """The trees up to the best round: ``log(mean) = base + margin``, the margin by ``model``."""

    model: GBTRegressionModel
    base: float
    #: Mean deviance after each round, 0 for the constant forecast that boosting starts from.
    train_deviance: list[float] = field(default_factory=list)
    valid_deviance: list[float] = field(default_factory=list)
    best_round: int = 0


def deviance(y: Column, margin: Column) -> Column:
    """Poisson deviance of one row with mean ``exp(margin)``."""
    logs = F.when(y > 0, y * (F.log(y) - margin)).otherwise(0.0)
    return 2.0 * (logs - y + F.exp(margin))


def ensemble(trees: list, weights: list[float], template) -> GBTRegressionModel:
    """Fitted trees and their weights as one model, which scores in one pass and is stored as one stage."""
    context = template.sparkSession.sparkContext
    jvm, gateway = context._jvm, context._gateway
    regression = jvm.org.apache.spark.ml.regression
    array = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    numbers = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        array[i], numbers[i] = tree._java_obj, float(weight)
    model = GBTRegressionModel(regression.GBTRegressionModel(f"poisson_{trees[0].uid}", array, numbers))
    return model.setFeaturesCol("inputs").setPredictionCol("margin")


def fit(
    train: DataFrame, valid: DataFrame, label: str = "departures", max_rounds: int = 200, learning_rate: float = 0.15,
    depth: int = 4, min_rows: int = 20, patience: int = 10, keep_every: int = 10, halvings: int = 4, seed: int = 42,
) -> Boosted:
    """Boost until ``patience`` rounds brought no lower validation deviance, at most ``max_rounds``.

    Both frames hold ``inputs`` (a vector) and ``label`` (not negative). Their margins are written to the shared folder
    every ``keep_every`` rounds, so that a lost executor costs few trees and plans stay short; between two writes, the
    few trees since are applied. Without validation rows the training deviance decides, without any training demand
    there is nothing to fit and a ``ValueError`` is raised.
    """
    y = F.col(label).cast("double")
    mean = train.agg(F.avg(y)).first()[0]
    if not mean or mean <= 0:
        raise ValueError("no demand in the training rows")
    base = float(train.select(F.log(F.lit(mean))).first()[0])
    marked = train.select("inputs", y.alias("y"), F.lit(False).alias("held")).unionByName(
        valid.select("inputs", y.alias("y"), F.lit(True).alias("held"))
    )
    rows = materialise(marked.withColumn("log_mean", F.lit(base)), "boosting").cache()
    steps = [learning_rate / 2**k for k in range(halvings + 1)]
    learner = DecisionTreeRegressor(
        featuresCol="inputs", labelCol="response", weightCol="mean", predictionCol="step", maxDepth=depth,
        minInstancesPerNode=min_rows, minInfoGain=0.0, seed=seed,
    )
    start = {r.held: r.d for r in rows.groupBy("held").agg(F.avg(deviance(F.col("y"), F.col("log_mean"))).alias("d")).collect()}
    judged_by = True in start
    out = Boosted(None, base, [start[False]], [start.get(True, start[False])])
    trees: list = []
    weights: list[float] = []
    since = 0  # trees whose steps are not yet part of log_mean
    while len(trees) < max_rounds and len(trees) - out.best_round < patience:
        now = rows
        if since:
            partial = ensemble(trees[-since:], weights[-since:], rows)
            now = partial.transform(rows).withColumn("log_mean", F.col("log_mean") + F.col("margin")).drop("margin")
        if since == keep_every:
            kept = materialise(now, "boosting").cache()
            rows.unpersist()
            rows, now, since = kept, kept, 0
        worked = now.where(~F.col("held")).withColumn("mean", F.exp("log_mean")).withColumn("response", (F.col("y") - F.col("mean")) / F.col("mean"))
        tree = learner.fit(worked)
        moved = tree.transform(now)
        tried = [F.avg(deviance(F.col("y"), F.col("log_mean") + s * F.col("step"))).alias(f"d{k}") for k, s in enumerate(steps)]
        found = {r.held: r for r in moved.groupBy("held").agg(*tried).collect()}
        # The longest step after which the training deviance is no higher; none may be left near the optimum.
        best = next((k for k in range(len(steps)) if found[False][f"d{k}"] <= out.train_deviance[-1]), None)
        if best is None or tree.numNodes == 1:
            break
        trees.append(tree)
        weights.append(steps[best])
        since += 1
        out.train_deviance.append(found[False][f"d{best}"])
        out.valid_deviance.append(found[judged_by][f"d{best}"])
        if out.valid_deviance[-1] < out.valid_deviance[out.best_round]:
            out.best_round = len(trees)
    rows.unpersist()
    if not trees:
        raise ValueError("no split improves on the mean")
    # At least one tree, so that there is a model to store; a weight of 0 leaves the constant forecast.
    last = max(1, out.best_round)
    out.model = ensemble(trees[:last], weights[:last] if out.best_round else [0.0], rows)
    return out
