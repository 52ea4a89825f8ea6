"""Boosting on the Poisson deviance."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from demandspark.operators import boost
from demandspark.operators import sequence as sq
from demandspark.operators import train as tr
from demandspark.params import Params


def rows(spark, n, seed, noise=False):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(-1, 1, n), rng.integers(0, 4, n)
    mean = np.full(n, 3.0) if noise else np.exp(1 + 1.2 * a + 0.5 * (b == 2))
    data = [(float(x), float(z), float(y)) for x, z, y in zip(a, b, rng.poisson(mean), strict=True)]
    table = spark.createDataFrame(data, "a double, b double, departures double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="inputs").transform(table)


def mean_deviance(y, mean):
    return float(np.mean(2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mean), 0) - y + mean)))


def test_deviance_falls_and_boosting_stops(spark):
    train, valid = rows(spark, 600, 1), rows(spark, 300, 2)
    found = boost.fit(train, valid, learning_rate=0.3, patience=3, max_rounds=40, keep_every=4)
    fall = np.diff(found.train_deviance)
    assert (fall <= 0).all()
    rounds = len(found.train_deviance) - 1
    assert rounds == found.best_round + 3 < 40
    assert min(found.valid_deviance) == found.valid_deviance[found.best_round]
    assert found.model.getNumTrees == found.best_round
    # The stored margin gives the deviance that was reported, and it is far below the constant forecast's.
    scored = found.model.transform(valid).select("departures", F.exp(F.col("margin") + found.base).alias("m")).toPandas()
    got = mean_deviance(scored.departures.to_numpy(), scored.m.to_numpy())
    assert got == pytest.approx(found.valid_deviance[found.best_round], rel=1e-9)
    assert got < 0.75 * found.valid_deviance[0]


def test_leaves_are_newton_steps(spark):
    """One tree with one split: each side moves by sum(y - m) / sum(m)."""
    train = rows(spark, 400, 3)
    found = boost.fit(train, train.limit(0), learning_rate=1.0, depth=1, max_rounds=1)
    table = found.model.transform(train).toPandas()
    mean = table.departures.mean()
    assert found.base == pytest.approx(np.log(mean))
    for margin, leaf in table.groupby("margin"):
        assert margin == pytest.approx((leaf.departures - mean).sum() / (mean * len(leaf)))
    assert table.margin.nunique() == 2


def test_noise_stops_at_once(spark):
    found = boost.fit(rows(spark, 300, 4, noise=True), rows(spark, 300, 5, noise=True), patience=2, max_rounds=30)
    assert found.best_round <= 3


def test_nothing_to_learn_is_an_error(spark):
    train = rows(spark, 50, 6)
    with pytest.raises(ValueError, match="no demand"):
        boost.fit(train.withColumn("departures", F.lit(0.0)), train)
    with pytest.raises(ValueError, match="no split"):
        boost.fit(train.withColumn("departures", F.lit(2.0)), train)


def test_pipeline_handles_missing_values_and_storage(spark, tmp_path):
    rng = np.random.default_rng(8)
    params = Params()
    names = params.features
    data = []
    for _ in range(300):
        values = [None if rng.random() < 0.2 else float(rng.normal()) for _ in names]
        data.append((*values, float(rng.poisson(np.exp(1 + (values[1] or 0.0))))))
    table = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names) + ", departures double")
    model = tr.fit_poisson(table, table, params, max_rounds=3, learning_rate=0.3)
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    here, there = (sorted(r.predicted for r in tr.predict(m, table).select("predicted").collect()) for m in (model, again))
    assert here == there and min(here) > 0
    top = tr.importance(model, 1).first()
    assert top.feature == names[1]


def sequences(spark, seed, entities, hours, length=168):
    """Weekly and daily waves at very different levels, with noise that lasts a few hours."""
    rng = np.random.default_rng(seed)
    data = []
    for level in entities:
        t = np.arange(hours + length)
        noise = np.convolve(rng.normal(size=hours + length + 5), np.ones(6) / 6, "valid")
        wave = 1 + 0.6 * np.sin(2 * np.pi * t / 24) + 0.3 * np.sin(2 * np.pi * t / 168) + 0.6 * noise
        x = level * np.clip(wave, 0, None)
        data += [(x[i : i + length].tolist(), float(x[i + length])) for i in range(hours)]
    return spark.createDataFrame(data, "sequence array<double>, target double").repartition(3)


def test_sequence_model_beats_last_week(spark, tmp_path):
    train, valid, test = (sequences(spark, s, (5, 300), 250) for s in (1, 2, 3))
    model = sq.fit(train, valid, 168, n_kernels=24)
    model.save(spark, str(tmp_path / "m"))
    assert sq.SequenceModel.load(spark, str(tmp_path / "m")) == model
    scored = model.transform(test).toPandas()
    week = np.array([s[0] for s in scored.sequence])
    assert len(scored) == 500
    assert (scored.raw - scored.target).abs().mean() < 0.7 * np.abs(week - scored.target).mean()


def test_ridge_equals_a_direct_solution(spark):
    train = sequences(spark, 4, (10,), 120, length=30)
    kernels = sq.Kernels(30, 5, 1)
    rows = train.toPandas()
    x, level = kernels.inputs(np.stack(rows.sequence))
    y = rows.target.to_numpy() / level
    inputs = x[:, :-1]
    z = (inputs - inputs.mean(0)) / inputs.std(0)
    w = np.linalg.solve(z.T @ z / len(z) + 0.1 * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(z))
    got = sq.ridge(sq.gram(train, kernels), 0.1)
    assert x @ got == pytest.approx(z @ w + y.mean(), abs=1e-8)


def test_short_constant_and_no_sequences(spark):
    flat = spark.createDataFrame([([0.0] * 5, 0.0)] * 20, "sequence array<double>, target double")
    model = sq.fit(flat, flat, 5)
    assert {round(r.raw, 9) for r in model.transform(flat).collect()} == {0.0}
    with pytest.raises(ValueError, match="no complete sequence"):
        sq.fit(flat.limit(0), flat, 5)
