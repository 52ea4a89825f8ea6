"""The pipeline's stages one after another against plain versions, and every query against its oracle."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from demandspark.llm import queries as llm
from tests.llm import test_lines, test_ngram_join, test_quality
from tests.oracle import connect, differences, rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    got = rows_of(llm.QUERIES[name](spark, SF_DIR))
    assert len(got)
    if name in llm.ORACLES:
        assert differences(got, connect(SF_DIR).execute(llm.ORACLES[name]).df()) == []


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = [tuple(r) for r in docs.select(names).collect()], [tuple(r) for r in out.collect()]
        if k < 4:
            assert out.columns == names
        if k == 0:
            base = [r for r in before if not (lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0])(test_quality.brute(r[1]))]
            assert sorted(after) == sorted(base)  # too few labels here to certify a cutoff
        elif k == 1:
            want = {(i, h) for i, _, _, h in test_lines.brute(before, 10, "none")}
            assert {(r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in after} == want
            assert all(r[4] == len(r[1]) for r in after)
        elif k == 2:
            found = {i: (n, c) for i, n, c in test_ngram_join.brute(before, 5, 80)}
            assert sorted(after) == sorted(r for r in before if found[r[0]][1] == r[0])
        elif k == 3:
            mixed = {r.doc_id: r.copies for r in __import__("demandspark.llm.mixing", fromlist=["x"]).mix_sources(docs).collect()}
            assert sorted(after) == sorted(r for r in before for _ in range(mixed[r[0]]))
        else:
            tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert sorted((r[0], r[1]) for r in after) == sorted((r[0], len(tool.encode(r[1]).ids)) for r in before)
        docs = out
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert whole.exceptAll(docs).count() == docs.exceptAll(whole).count() == 0


def test_awkward_rows_run_through(spark):
    from tests.llm.fixtures import CLASHING, documents

    docs = documents(spark).withColumns({c: F.lit("x") for c in CLASHING})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        assert out.count() >= 0
        docs = out if k < 4 else docs
