"""Token counts against the tokenizers library, whatever the table and the cache hold."""

import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from demandspark.llm import token_counts as op
from demandspark.llm.bpe import vocabulary_path
from tests.llm.fixtures import documents, with_clashes


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(library, rows, limit=512):
    out = []
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


EXTRA = [
    (200, "a<|endoftext|>b <|endoftext|><|endoftext|> <|endoftex", "en", "a", 1),
    (201, " leading  two\n\n three 　wide hard\x85next\x1cfs", "en", "a", 1),
    (202, "can't I'll we'VE 12345 don't!!! ...\t\t\tx", "en", "a", 1),
    (203, "y" * 3000 + " " * 3000 + "ü" * 3000, "en", "a", 1),
]


@pytest.mark.parametrize("table", [0, 3, op.TABLE])
def test_equal_to_the_library(spark, library, table):
    docs = with_clashes(documents(spark)).union(with_clashes(spark.createDataFrame(EXTRA, documents(spark).schema)))
    got = op.count_tokens(docs.withColumnRenamed("name", "n_tokens"), vocabulary_path(), table_size=table)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(got) == brute(library, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_bounds_change_nothing(spark, library, monkeypatch):
    """Small windows, caches and summaries, so that each of them overflows."""
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "c", " ", "\n", "é", "1", "<|endoftext|>", "!"]) for _ in range(20_000))
    for name in ("WINDOW", "CACHE", "COUNTED"):
        monkeypatch.setattr(op, name, 50)
    with open(vocabulary_path(), encoding="utf-8") as f:
        count = op.TokenCounter(f.read(), op.pack([(" c", 1), ("ab", 1)]))
    assert count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert "".join(op.windows(text, count.gap)) == text


def test_table_holds_the_frequent_ones(spark):
    rows = [(i, " the" * 50 + f" rare{i}" + " of" * 20, "en", "a", 1) for i in range(300)]
    found = op.frequent(documents(spark, rows).repartition(7), 2)
    assert found == [(" the", 300 * 50), (" of", 300 * 20)]


def test_packing_round_trip():
    entries = [("", 0), (" a", 1), ("日本", 7), ("x" * 64, 1 << 40)]
    assert list(op.unpack(*op.pack(entries))) == entries
    assert list(op.unpack(*op.pack([]))) == []


def test_empty_table(spark):
    assert op.count_tokens(documents(spark, []), vocabulary_path()).collect() == []
