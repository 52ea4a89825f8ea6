"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams are hashed into a fixed number of features and weighted by TF-IDF; document frequencies are
counted over all training documents. Weights are learned by follow-the-regularised-leader with L1 and L2 penalties
(FTRL-proximal): shards of a bounded training sample run it side by side on the executors, and the sums ``z`` and ``n``
that FTRL keeps, of which the weights are a function, are averaged after every pass and carried into the next one. A part of the sample is held back to fit one temperature that calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import batch_of, column, read_table
from demandspark.session import materialise

LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """``max_train`` bounds the sample that weights and temperature are fitted on; document frequencies have no bound."""

    features: int = 1 << 14
    orders: int = 3
    max_train: int = 12_000
    shards: int = 8
    passes: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


def features(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and how often each occurs in the whole text, lower-cased."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(s.features, np.int64)
    gram = np.zeros(len(points), np.uint64)
    for order in range(1, s.orders + 1):
        if len(points) < order:
            break
        last = len(points) - order + 1
        gram = gram[:last] * np.uint64(0x100000001B3) + points[order - 1 :] + np.uint64(order)
        spread = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        total += np.bincount((spread % np.uint64(s.features)).astype(np.int64), minlength=s.features)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str, idf: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length TF-IDF features; a logarithm damps the counts."""
    at, n = features(text, s)
    x = (1 + np.log(n)) * idf[at]
    length = np.sqrt((x * x).sum())
    return at, x / length if length else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal state: the weights follow from the sums ``z`` and ``n`` and are exactly 0 within L1."""

    def __init__(self, z: np.ndarray, n: np.ndarray, s: Settings):
        self.z, self.n, self.s = z.copy(), n.copy(), s

    def weights(self, at=slice(None)) -> np.ndarray:
        z, s = self.z[at], self.s
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


@dataclass(frozen=True)
class Model:
    """Everything a prediction needs: its size is features x languages."""

    settings: Settings
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not LETTER.search(text):
            return "und", 0.0
        at, x = vector(text, self.idf, self.settings)
        p = softmax(x @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequency(docs: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """Over all given documents: one number per feature, summed in each task before it is sent."""
    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(s.features, np.int64), 0
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                df[features(text or "", s)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield batch_of(schema, pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n)))

    rows = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, n_docs = np.zeros(s.features), 0
    for r in rows:
        if r.feature < 0:
            n_docs = r.n
        else:
            df[r.feature] = r.n
    return df, n_docs


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from ``text`` and ``lang`` of ``docs``; rows with a null of either, or without a letter, take no part."""
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").count().orderBy("lang").collect()  # one row per language
    languages = tuple(r.lang for r in counts)
    df, n_docs = document_frequency(usable, s)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    z, n = (np.zeros((s.features, len(languages))) for _ in range(2))
    if not languages:
        return Model(s, (), idf, z, 1.0)
    # Sampled by hash; each language may fill an equal part of the bound, so that rare ones are learned too.
    share = -(-s.max_train // len(languages))
    chance = F.lit(float(share)) / F.get(F.array(*[F.lit(float(r["count"])) for r in counts]), F.col("label"))
    lang_no = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1
    ticket = F.xxhash64(F.lit("train"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    drawn = usable.select("text", lang_no.alias("label"), ticket.alias("ticket"))
    near = drawn.where((F.pmod("ticket", F.lit(1 << 20)) / float(1 << 20)) < 1.2 * chance)
    by = Window.partitionBy("label").orderBy(F.pmod("ticket", F.lit(1 << 20)), "ticket", "text")
    sample = near.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= share).drop("_r")

    schema = pa.schema([("shard", pa.int32()), ("ticket", pa.int64()), ("label", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label, t in zip(*(column(batch, c).to_pylist() for c in ("text", "label", "ticket")), strict=True):
                at, x = vector(text, idf, s)
                part = (t >> 8) & 0xFFFF
                # A fifth, in shard -1, calibrates.
                shard = -1 if part % 5 == 0 else part % s.shards
                rows.append((shard, t, label, at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()))
            yield batch_of(schema, *(list(zip(*rows, strict=True)) or [[]] * 5))

    data = materialise(sample.mapInArrow(vectors, "shard int, ticket long, label int, at binary, x binary"), "vectors")
    fit = data.where("shard >= 0").repartition(s.shards, "shard").sortWithinPartitions("shard", "ticket", "label")

    def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for shard, label, at, x in zip(*(column(batch, c).to_pylist() for c in ("shard", "label", "at", "x")), strict=True):
            yield shard, label, np.frombuffer(at, np.int32), np.frombuffer(x, np.float32).astype(np.float64)

    n_fit = data.where("shard >= 0").count()
    for _ in range(s.passes):
        start = spark.sparkContext.broadcast((z, n))

        def learn(batches: Iterable[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            out = pa.schema([("shard", pa.int32()), ("at", pa.binary()), ("dz", pa.binary()), ("dn", pa.binary()), ("rows", pa.int64())])
            state, current, rows, met = None, None, 0, None

            def moved() -> pa.RecordBatch:
                """How far the shard has moved the features that it has met; the others are not sent."""
                at = np.flatnonzero(met)
                dz, dn = state.z[at] - start.value[0][at], state.n[at] - start.value[1][at]
                return batch_of(out, [current], [at.astype(np.int64).tobytes()], [dz.tobytes()], [dn.tobytes()], [rows])

            for batch in batches:
                for shard, label, at, x in unpack(batch):
                    if shard != current:
                        if state is not None:
                            yield moved()
                        state, current, rows, met = Ftrl(*start.value, s), shard, 0, np.zeros(s.features, bool)
                    state.learn(at, x, label)
                    met[at] = True
                    rows += 1
            if state is not None:
                yield moved()

        # One row per shard, learned side by side, then added one after the other in the order of the shards.
        moves = materialise(fit.mapInArrow(learn, "shard int, at binary, dz binary, dn binary, rows long"), "moves")
        for part in moves.orderBy("shard").toLocalIterator():
            at = np.frombuffer(bytes(part.at), np.int64)
            for total, moved in ((z, part.dz), (n, part.dn)):
                total[at] += np.frombuffer(bytes(moved)).reshape(len(at), -1) * (part.rows / n_fit)

    weights = Ftrl(z, n, s).weights()
    final = spark.sparkContext.broadcast(weights)

    def logits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("label", pa.int32()), ("z", pa.list_(pa.float64()))])
        for batch in batches:
            rows = [(label, (x @ final.value[at]).tolist()) for _, label, at, x in unpack(batch)]
            yield batch_of(out, *(list(zip(*rows, strict=True)) or [[], []]))

    held = data.where("shard = -1").mapInArrow(logits, "label int, z array<double>").collect()  # within the sample's bound
    return Model(s, languages, idf, weights, temperature([(r.label, r.z) for r in held]))


def temperature(held: list[tuple[int, list[float]]]) -> float:
    """The temperature with the smallest log loss, by golden section on its logarithm; 1 without data."""
    if not held:
        return 1.0
    labels, z = np.array([h[0] for h in held]), np.array([h[1] for h in held])

    def loss(log_t: float) -> float:
        p = softmax(z / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per row: ``und`` with score 0 for a null text, one without a letter, or a
    model that has learned no language. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in column(batch, "text").to_pylist()]
            yield batch_of(schema, column(batch, "doc_id"), *(list(zip(*found, strict=True)) or [[], []]))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Documents that nothing is learned from: CRC of the id leaves 2 modulo 4. Rows without an id are not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict_languages(docs, train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
