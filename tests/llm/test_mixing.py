import re

import pytest
from pyspark.sql import functions as F

from demandspark.llm.mixing import mix_sources
from tests.llm.fixtures import awkward, documents, with_clashes


def targets(sizes, weights, budget, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = budget * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in sizes}
        over = {s for s in free if t[s] >= cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets_and_takings(spark):
    rows = awkward(n=400)
    out = mix_sources(documents(spark, rows)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    want = targets(sizes, (3, 1, 2), 1.5, 2)
    assert len(out) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.size == count(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(count(r[1]) for r in rows if r[3] == s)


def test_close_to_target_and_same_again(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
    )
    out = mix_sources(docs)
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want")).collect():
        assert abs(r.t - r.want) <= 20
    again = mix_sources(docs.repartition(5))
    assert out.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).count() == 0


def test_weighted_documents(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source"),
        (1 + F.col("id") % 3).alias("w"),
    )
    out = mix_sources(docs, weights=(1, 1), budget=0.5, doc_weight="w").groupBy("w").agg(F.sum("copies").alias("n")).collect()
    n = {r.w: r.n for r in out}
    assert sum(n.values()) == pytest.approx(3000, abs=2)
    assert n[3] / n[1] == pytest.approx(3, rel=0.2) and n[2] / n[1] == pytest.approx(2, rel=0.2)


def test_excess_of_a_heavy_document_is_shared_again(spark):
    rows = [(i, "word", "s", 100.0 if i == 0 else 1.0) for i in range(10)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, w double"), doc_weight="w").collect()
    assert sum(r.taken for r in out) == 15 and {r.copies for r in out if r.doc_id == 0} == {2}


def test_weighted_sources_reach_their_targets(spark):
    """Weights over many orders of magnitude, ties, zeros and nulls: every source ends within its cut document."""
    i = F.col("id")
    docs = spark.range(9000).select(
        i.alias("doc_id"), F.repeat(F.lit("w "), (i % 13).cast("int")).alias("text"), (i % 3).cast("string").alias("source"),
        F.when(i % 7 == 0, 0.0).when(i % 11 != 0, F.pow(F.lit(1.01), (i * 7919) % 2000)).alias("w"),
    )
    out = mix_sources(docs, weights=(3, 1, 2), budget=1.2, doc_weight="w")
    per = out.groupBy("source").agg(
        F.sum("taken").alias("t"), F.max("target").alias("want"), F.sum(F.when(F.col("w") > 0, F.col("size"))).alias("usable"),
        F.count_if((F.coalesce("w", F.lit(0.0)) <= 0) & (F.col("taken") > 0)).alias("wrong"),
    ).collect()
    assert len(per) == 3
    for r in per:
        assert r.wrong == 0 and abs(r.t - min(r.want, 2 * r.usable)) <= 7
    assert any(r.want < 2 * r.usable for r in per) and any(r.want > 2 * r.usable for r in per)


def test_no_python_on_the_main_path(spark):
    plan = mix_sources(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LogicalRDD", ""))


def test_awkward(spark):
    docs = with_clashes(documents(spark))
    out = mix_sources(docs)
    assert out.count() == docs.count() and [c for c in out.columns if c in docs.columns]
    assert mix_sources(documents(spark, [])).count() == 0
    empties = documents(spark, [(1, None, None, "a", 0), (2, "", None, "b", 0)])
    assert {(r.size, r.taken, r.target) for r in mix_sources(empties).collect()} == {(0, 0, 0.0)}
