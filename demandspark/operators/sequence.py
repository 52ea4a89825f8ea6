"""Forecasts from the sequence of the preceding hours: random convolution kernels and a ridge regression.

A sequence is divided by its own level, so that one model serves busy and quiet entities. Each random kernel slides over
it with gaps of its own width and leaves two numbers, its largest answer and the share of answers above 0; with the
values of the same hour on earlier days and of the last hours they are the inputs of a linear model. Its Gram matrix is
summed in one pass, a matrix of fixed size per task, and serves every penalty that is tried.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.stats import regression_aggregates

TAPS = 9
RECENT = 6
PENALTIES = (1e-3, 1e-2, 1e-1, 1.0, 10.0)


@dataclass(frozen=True)
class Kernels:
    """Random kernels for sequences of one length; the same seed draws the same ones."""

    length: int
    n: int = 64
    seed: int = 42

    def draw(self) -> list[tuple[np.ndarray, int, float]]:
        """Weights with mean 0, the gap between two taps, and the bias, each drawn at random."""
        rng = np.random.default_rng(self.seed)
        widest = max(1, (self.length - 1) // (TAPS - 1))
        out = []
        for _ in range(self.n):
            weights = rng.normal(size=TAPS)
            gap = int(2 ** rng.uniform(0, np.log2(widest + 1)))
            out.append((weights - weights.mean(), min(gap, widest), float(rng.uniform(-1, 1))))
        return out

    def inputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(inputs, level)`` of sequences, one per row, oldest value first; the last input is constant."""
        level = np.abs(x).mean(axis=1) + 1.0
        z = x / level[:, None]
        columns = [z[:, -k] for k in range(1, min(RECENT, self.length) + 1)]
        columns += [z[:, -k] for k in range(24, self.length + 1, 24)]
        for weights, gap, bias in self.draw() if self.length >= TAPS else ():
            width = self.length - gap * (TAPS - 1)
            answers = sum(w * z[:, k * gap : k * gap + width] for k, w in enumerate(weights)) + bias
            columns += [answers.max(axis=1), (answers > 0).mean(axis=1)]
        return np.column_stack([*columns, np.ones(len(x))]), level


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def gram(sequences: DataFrame, kernels: Kernels) -> np.ndarray:
    """The sum over all rows of the outer product of (inputs, scaled target) with itself.

    A task sends one matrix, the session's shuffle partitions add them up, and the driver adds what they leave.
    """
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])

    def row(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, level = kernels.inputs(_matrix(batch.column("sequence")))
                all_ = np.column_stack([x, batch.column("target").to_numpy(zero_copy_only=False) / level])
                total = all_.T @ all_ if total is None else total + all_.T @ all_
        yield from row(total)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for packed in batch.column("sums").to_pylist():
                one = np.frombuffer(packed)
                total = one.copy() if total is None else total + one
        yield from row(total)

    rows = sequences.select("sequence", F.col("target").cast("double").alias("target"))
    parts = rows.mapInArrow(summed, "part int, sums binary").repartition("part").mapInArrow(merged, "part int, sums binary")
    found = [np.frombuffer(bytes(r.sums)) for r in parts.select("sums").toLocalIterator()]
    if not found:
        raise ValueError("no complete sequence to learn from")
    size = round(len(found[0]) ** 0.5)
    return np.sum(found, axis=0).reshape(size, size)


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Weights for standardised inputs, brought back to the inputs' own scale; the constant carries no penalty."""
    n = sums[-2, -2]
    mean, target_mean = sums[:-2, -2] / n, sums[-1, -2] / n
    spread = np.sqrt(np.maximum(np.diag(sums)[:-2] / n - mean**2, 0))
    spread[spread < 1e-9] = np.inf  # a constant input explains nothing
    covariance = (sums[:-2, :-2] / n - np.outer(mean, mean)) / np.outer(spread, spread)
    answer = (sums[:-2, -1] / n - mean * target_mean) / spread
    weights = np.linalg.solve(covariance + penalty * np.eye(len(mean)), answer) / spread
    return np.append(weights, target_mean - mean @ weights)


@dataclass(frozen=True)
class SequenceModel:
    kernels: Kernels
    weights: tuple[float, ...]
    penalty: float

    def transform(self, sequences: DataFrame) -> DataFrame:
        """Adds ``raw``, the forecast of the hour behind each sequence. Sequences have the length of the training ones."""
        return _with_forecasts(sequences, self.kernels, {"raw": self.weights})

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON, written where the other models are."""
        k = self.kernels
        text = json.dumps({"length": k.length, "n": k.n, "seed": k.seed, "weights": self.weights, "penalty": self.penalty})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SequenceModel":
        found = json.loads(spark.read.text(path, wholetext=True).first().value)
        return cls(Kernels(found["length"], found["n"], found["seed"]), tuple(found["weights"]), found["penalty"])


def _with_forecasts(sequences: DataFrame, kernels: Kernels, models: dict[str, Iterable[float]]) -> DataFrame:
    weights = np.array(list(models.values())).T
    plain = sequences.drop(*models)
    names = list(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, level = kernels.inputs(_matrix(batch.column("sequence")))
            found = (x @ weights) * level[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in found.T]], [*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, fields + "".join(f", `{n}` double" for n in names))


def fit(train: DataFrame, valid: DataFrame, length: int, n_kernels: int = 64, seed: int = 42) -> SequenceModel:
    """Fit on rows ``(sequence, target)`` of complete sequences; the penalty with the least validation error wins.

    All rows are used, on both sides, and each side is read once.
    """
    kernels = Kernels(length, n_kernels, seed)
    sums = gram(train, kernels)
    tried = {f"_p{i}": ridge(sums, p) for i, p in enumerate(PENALTIES)}
    scored = _with_forecasts(valid.select("sequence", "target"), kernels, tried)
    errors = scored.agg(*[regression_aggregates("target", name)[0].alias(name) for name in tried]).first()
    best = min(tried, key=lambda name: (errors[name] is None, errors[name] or 0.0))
    return SequenceModel(kernels, tuple(map(float, tried[best])), PENALTIES[int(best[2:])])
