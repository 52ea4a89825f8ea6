import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.llm.ann import Codebook, Settings, nearest

DDL = "vec_id long, embedding array<float>, label int"


def exact(vectors, queries, k):
    out = []
    for q in queries:
        d = sorted((float(np.sqrt(((np.asarray(v, np.float64) - np.asarray(vectors[q], np.float64)) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(d[:k])]
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = nearest(df, F.col("vec_id") % 20 == 0, s=Settings(cell_entries=8, chunk=16, probe_sample=12)).collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    want = exact(vectors, range(0, 500, 20), 10)
    hits = {(q, i) for q, _, i, _ in want} & {(r.query_id, r.vec_id) for r in got}
    assert len(hits) / len(want) >= 0.9 and len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(float(np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())), rel=1e-12)


def test_ties_go_to_smaller_ids_in_a_crowded_cell(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.5], 0) for i in range(300)] + [(i, [float(i), 1.0, 2.0, 3.0], 0) for i in range(300, 340)]
    got = nearest(spark.createDataFrame(rows, DDL).repartition(4), F.col("vec_id").isin(0, 150), s=Settings(cell_entries=4, chunk=32)).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 150)}
    assert by == {0: list(range(1, 11)), 150: list(range(10))}
    assert {r.score for r in got} == {0.0}


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i % 5 + 1), float(i)], 1) for i in range(0, 6)]
    bad = [(100, None, 1), (200, [0.0, 0.0], 1), (300, [1.0, None], 1), (400, [float("nan"), 1.0], 1), (500, [float("inf"), 1.0], 1), (600, [1.0], 1), (700, [], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(good + bad + good[:2], DDL).withColumns({"cell": F.lit(1), "v": F.lit("x"), "score": F.lit(2)})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert [g[:3] for g in got] == [w[:3] for w in exact({r[0]: r[1] for r in good}, [0], 10)] and len(got) == 5
    assert nearest(spark.createDataFrame([], DDL), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest(spark.createDataFrame(bad, DDL), F.col("vec_id") % 100 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_walk_is_in_order():
    rng = np.random.default_rng(2)
    book = Codebook((rng.normal(size=(7, 3)), rng.normal(size=(5, 2))))
    q = rng.normal(size=5)
    cells = list(book.walk(q))
    sums = [((q[:3] - book.halves[0][c // 5]) ** 2).sum() + ((q[3:] - book.halves[1][c % 5]) ** 2).sum() for c in cells]
    assert sorted(cells) == list(range(35)) and np.allclose(sums, sorted(sums))


def test_every_length_has_its_index(spark):
    """No length is left out, as query or candidate, whichever is the most frequent; an id may come in two lengths."""
    rng = np.random.default_rng(3)
    by = {d: {i: rng.normal(size=d).tolist() for i in ids} for d, ids in ((2, range(90, 140)), (3, [200, 4, 5]), (1, [300, 7]), (5, [400]))}
    by[3][100] = [0.5, 0.5, 0.5]
    rows = [(i, v, 0) for part in by.values() for i, v in part.items()]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0).collect())
    want = [w[:3] for d, queries in ((2, [100]), (3, [100, 200]), (1, [300])) for w in exact(by[d], queries, 10)]
    assert got == sorted(want)
