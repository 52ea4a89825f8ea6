import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from demandspark.llm.langid import Ftrl, Settings, document_frequency, held_out, predict_languages, temperature, train
from tests.llm.fixtures import awkward, documents, with_clashes

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = predict_languages(docs, train(docs.where(~held_out()))).join(docs.select("doc_id", "lang"), "doc_id").where(held_out())
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert n > 200 and right / n >= 0.97
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_same_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = predict_languages(docs, train(docs))
    again = predict_languages(docs, train(docs.repartition(5)))
    assert first.exceptAll(again).count() == 0


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark))
    out = predict_languages(docs, train(docs)).collect()
    assert len(out) == len(awkward())
    for r in awkward():
        found = [o for o in out if o.doc_id == r[0]]
        if r[1] is None or not any(c.isalpha() for c in r[1]):
            assert any((o.lang_pred, o.score) == ("und", 0.0) for o in found)
    empty = documents(spark, [])
    assert predict_languages(empty, train(empty)).count() == 0
    assert {(r.lang_pred, r.score) for r in predict_languages(docs, train(empty)).collect()} == {("und", 0.0)}


def test_learning_reads_only_text_and_lang(spark):
    docs = documents(spark).where("doc_id is not null")
    lied = docs.withColumns({"source": F.lit("en"), "n_chars": F.lit(1).cast("long")})
    a, b = (predict_languages(docs, train(d)) for d in (docs, lied))
    assert a.exceptAll(b).count() == 0


def test_l1_gives_exact_zeros():
    s = Settings(features=64, l1=0.5)
    f = Ftrl(np.zeros((64, 3)), np.zeros((64, 3)), s)
    for i in range(200):
        f.learn(np.array([i % 2, 5 + i % 40]), np.array([1.0, 0.05]), i % 2)
    assert (f.weights()[45:] == 0).all() and (f.weights()[:2] != 0).any()


def plain_ftrl(rows, n_features, n_labels, s, passes):
    """The published update, coordinate by coordinate."""
    z, n = ([[0.0] * n_labels for _ in range(n_features)] for _ in range(2))

    def weight(i, k):
        if abs(z[i][k]) <= s.l1:
            return 0.0
        return -(z[i][k] - math.copysign(s.l1, z[i][k])) / ((s.beta + math.sqrt(n[i][k])) / s.alpha + s.l2)

    for _ in range(passes):
        for at, x, label in rows:
            w = [[weight(i, k) for k in range(n_labels)] for i in at]
            scores = [sum(v * w[j][k] for j, v in enumerate(x)) for k in range(n_labels)]
            e = [math.exp(v - max(scores)) for v in scores]
            for j, i in enumerate(at):
                for k in range(n_labels):
                    g = x[j] * (e[k] / sum(e) - (k == label))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / s.alpha
                    z[i][k] += g - sigma * w[j][k]
                    n[i][k] += g * g
    return np.array([[weight(i, k) for k in range(n_labels)] for i in range(n_features)])


def plain_features(text, s):
    """Hashed n-grams of the lower-cased text and their counts."""
    points, found = [ord(c) for c in text.lower()], Counter()
    for order in range(1, s.orders + 1):
        for i in range(len(points) - order + 1):
            gram = 0
            for k in range(order):
                gram = (gram * 0x100000001B3 + points[i + k] + k + 1) % (1 << 64)
            found[(gram * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % s.features] += 1
    return found


def test_one_shard_equals_the_plain_version(spark):
    """The state outlives a pass: three passes over one shard are three runs of one learner."""
    s = Settings(features=512, shards=1, passes=3)
    texts = {"en": "the cat sat on the mat {}", "de": "die katze saß auf der matte {}", "fr": "le chat était assis {}"}
    rows = [(i, texts[x].format(i * i), x, None, 0) for i, x in enumerate(["en", "de", "fr"] * 30)]
    docs = documents(spark, rows)
    model = train(docs, s)
    df, n_docs = document_frequency(docs, s)
    plain_df = Counter(f for r in rows for f in plain_features(r[1], s))
    assert n_docs == len(rows) and [df[i] for i in range(s.features)] == [plain_df[i] for i in range(s.features)]
    idf = [math.log((1 + n_docs) / (1 + plain_df[i])) + 1 for i in range(s.features)]
    sample = docs.select("text", F.xxhash64(F.lit("train"), F.col("doc_id").cast("string"), "text").alias("t"), "lang").collect()
    fit = []
    for r in sorted((r for r in sample if ((r.t >> 8) & 0xFFFF) % 5), key=lambda r: r.t):
        found = plain_features(r.text, s)
        x = {i: (1 + math.log(c)) * idf[i] for i, c in sorted(found.items())}
        length = math.sqrt(sum(v * v for v in x.values()))
        fit.append((list(x), [float(np.float32(v / length)) for v in x.values()], ["de", "en", "fr"].index(r.lang)))
    want = plain_ftrl(fit, s.features, 3, s, s.passes)
    assert np.allclose(model.weights, want, atol=1e-7) and (want == 0).any() and (want != 0).any()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(3000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    labels = [int(rng.choice(3, p=x)) for x in p]
    assert abs(temperature(list(zip(labels, (z * 4).tolist(), strict=True))) - 4) < 0.5
    assert temperature([]) == 1.0
