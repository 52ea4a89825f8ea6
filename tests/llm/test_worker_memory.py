import tracemalloc
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa

from demandspark.llm import bpe, lines
from demandspark.llm.quality import with_measures

ROWS = 6000


class Recorder:
    """Stands for a DataFrame and its session: keeps what is given to mapInArrow, for a batch as a Python worker gets it."""

    columns, schema = ["doc_id", "text"], []

    def __init__(self):
        self.sparkSession = self.sparkContext = self
        self.given = []

    def mapInArrow(self, run, ddl):
        self.given.append(run)
        return self

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def first(self):
        return [0]

    def toLocalIterator(self):
        return iter(())

    def __getattr__(self, name):
        return lambda *args, **how: self


def text_of(i):
    return "\n".join(f"line {i} {k} " + "considerable quantities of plaintext " * 4 for k in range(12))


def peak(run, batch):
    """MB of Python objects while a worker goes through the batch and drops what it returns."""
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found / 1e6


def test_workers_hold_few_texts_of_a_batch_at_a_time(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(ROWS)), "text": pa.array(map(text_of, range(ROWS)), pa.string())})
    most = batch.nbytes / 2e6
    measures, dedup, tokens = Recorder(), Recorder(), Recorder()
    with_measures(measures)
    monkeypatch.setattr(lines, "materialise", lambda df, name: df)
    lines.dedup_lines(dedup, min_docs=10, keep="none")
    bpe.digests(tokens, public_tokenizers.path("byte_bpe_50k.json"))
    list(tokens.given[0](iter([batch.slice(0, 10)])))  # reads the vocabulary
    hashed, _, count, apply = dedup.given
    held = {run.__qualname__: peak(run, batch) for run in (measures.given[0], hashed, count, apply, tokens.given[0])}
    assert max(held.values()) < most, (most, held)
