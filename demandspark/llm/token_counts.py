"""Token counts by a two-tier lookup on the map side.

Texts are cut into pre-tokens, runs of white space with the characters behind them, over whose ends no token reaches. A
first pass gathers the frequent pre-tokens of all texts: every task keeps a bounded summary, and the summaries, not the
pre-tokens, are merged. Their token counts are broadcast as one packed table. The second pass adds up the counts of each
text's pre-tokens: the frequent ones from the table, the others from a bounded cache of the Python worker, which encodes
what it does not hold. No pre-token is shuffled, and the table only saves work: a count never depends on it.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.bpe import WHITE, codec, shared_spec, vocabulary_path
from demandspark.llm.common import batch_of, column, read_table

#: Pre-tokens in the broadcast table, and in what a task or a merge hands on.
TABLE = 1 << 14
#: Distinct pre-tokens that a task counts before it drops the rare half.
COUNTED = 1 << 18
#: Counts that a Python worker remembers, in each of two generations.
CACHE = 1 << 17
#: Characters of a pre-token that is worth a place in table or cache.
LONGEST = 64
#: Merged summaries that the driver adds up.
LAST = 8
#: Characters that are cut into pre-tokens at a time.
WINDOW = 1 << 18


def windows(text: str, gap: re.Pattern) -> Iterator[str]:
    """The text in parts of about ``WINDOW`` characters, each ending where a run of white space begins."""
    at = 0
    while len(text) - at > WINDOW:
        found = gap.search(text, at + WINDOW - 1)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def strongest(counts: dict[str, int], n: int) -> list[tuple[str, int]]:
    """The ``n`` largest counts; ties by pre-token, so that reruns agree."""
    return heapq.nsmallest(n, counts.items(), key=lambda e: (-e[1], e[0]))


def shed(counts: dict[str, int]) -> Counter[str]:
    """The counts above the median: at most half of them."""
    cut = sorted(counts.values())[len(counts) // 2]
    return Counter({k: n for k, n in counts.items() if n > cut})


def pack(entries: Iterable[tuple[str, int]]) -> tuple[bytes, bytes, bytes]:
    """Pre-tokens end to end, their lengths in bytes (at most four a character), their numbers."""
    raw = [(k.encode("utf-8"), n) for k, n in entries]
    return (
        b"".join(k for k, _ in raw), np.array([len(k) for k, _ in raw], np.uint16).tobytes(), np.array([n for _, n in raw], np.int64).tobytes(),
    )


def unpack(keys: bytes, lengths: bytes, numbers: bytes) -> Iterator[tuple[str, int]]:
    ends = np.cumsum(np.frombuffer(lengths, np.uint16), dtype=np.int64).tolist()
    starts = [0, *ends[:-1]] if ends else []
    return zip((keys[s:e].decode("utf-8") for s, e in zip(starts, ends, strict=True)), np.frombuffer(numbers, np.int64).tolist(), strict=True)


class Misses(dict):
    """Second tier: token counts of pre-tokens that the table lacks, in two generations."""

    def __init__(self, tool):
        super().__init__()
        self.tool, self.old = tool, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = sum(map(self.word, self.tool.word.findall(piece)))
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = n
        return n

    def word(self, word: str) -> int:
        ids = self.tool.words.get(word)
        if ids is None:
            ids = tuple(self.tool.merge(word.encode()))
            if len(word) <= LONGEST:
                self.tool.words.put(word, ids)
        return len(ids)


class Counts(dict):
    """First tier: the broadcast table; what it lacks is asked of the second."""

    def __init__(self, table: tuple[bytes, bytes, bytes], misses: Misses):
        super().__init__(unpack(*table))
        self.misses = misses

    def __missing__(self, piece: str) -> int:
        return self.misses[piece]


class TokenCounter:
    """Counts the tokens of texts with the two tiers."""

    def __init__(self, spec: str, table: tuple[bytes, bytes, bytes]):
        self.tool = codec(spec)
        self.tiers = Counts(table, Misses(self.tool))
        self.gap = re.compile(f"[^{WHITE}](?=[{WHITE}])")

    def plain(self, text: str) -> int:
        find, look = self.tool.piece.findall, self.tiers.__getitem__
        return sum(sum(map(look, find(part))) for part in windows(text, self.gap))

    def __call__(self, text: str) -> int:
        if self.tool.split is None or self.tool.split.search(text) is None:
            return self.plain(text)
        total = at = 0
        for special in self.tool.split.finditer(text):
            total += self.plain(text[at : special.start()]) + 1
            at = special.end()
        return total + self.plain(text[at:])


@lru_cache(maxsize=2)
def counter(spec: str, table: tuple[bytes, bytes, bytes]) -> TokenCounter:
    """One per Python worker, kept between its tasks."""
    return TokenCounter(spec, table)


def frequent(docs: DataFrame, size: int = TABLE) -> list[tuple[str, int]]:
    """About the ``size`` most frequent pre-tokens of all texts with their counts.

    A task that holds ``COUNTED`` distinct pre-tokens drops the rarer half; at its end it hands on its ``size``
    strongest, packed in one row. These summaries are merged in the session's shuffle partitions, then in ``LAST`` ones,
    and added up by the driver: each has a bounded size. Counts of what was dropped on the way are too low, which costs
    a later lookup and nothing else.
    """
    piece, gap = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"), re.compile(f"[^{WHITE}](?=[{WHITE}])")
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()), ("numbers", pa.binary())])

    def row(counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        if counts:
            yield batch_of(schema, [TaskContext.get().partitionId()], *([v] for v in pack(strongest(counts, size))))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                for part in windows(text or "", gap):
                    counts.update(piece.findall(part))
                    if len(counts) > COUNTED:
                        counts = shed(counts)
        yield from row({k: n for k, n in counts.items() if len(k) <= LONGEST})

    def added(rows: Iterable[tuple[bytes, bytes, bytes]]) -> dict[str, int]:
        counts: Counter[str] = Counter()
        for packed in rows:
            for key, n in unpack(*packed):
                counts[key] += n
            if len(counts) > COUNTED:
                counts = shed(counts)
        return counts

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names[1:]
        yield from row(added(r for b in batches for r in zip(*(column(b, n).to_pylist() for n in names), strict=True)))

    fields = "part int, keys binary, lengths binary, numbers binary"
    summaries = docs.select("text").mapInArrow(summed, fields)
    summaries = summaries.repartition("part").mapInArrow(merged, fields).repartition(LAST).mapInArrow(merged, fields)
    rows = summaries.select("keys", "lengths", "numbers").toLocalIterator()
    return strongest(added(tuple(map(bytes, r)) for r in rows), size)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, table_size: int = TABLE) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` names a byte-level BPE vocabulary in the tokenizers library's JSON form. Counts are the library's for whole
    texts: no tokens are added, strings of special tokens in a text count one each, nothing is truncated. A null text is
    an empty one, with 0 tokens. Repeated rows and rows without an id are counted each; an empty table gives an empty
    result. Columns other than doc_id and text are ignored, whatever their names. A text is held once and cut in parts
    of bounded size; only a run without white space is taken whole.
    """
    spark = docs.sparkSession
    spec = shared_spec(spark, path)
    with open(path, encoding="utf-8") as f:
        plain = TokenCounter(f.read(), (b"", b"", b""))
    # Its size is bounded by table_size entries of LONGEST characters.
    table = spark.sparkContext.broadcast(pack((k, plain(k)) for k, _ in frequent(docs, table_size)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(spec.value, table.value)
        for batch in batches:
            tokens = [count(t or "") for t in column(batch, "text").to_pylist()]
            yield batch_of(schema, column(batch, "doc_id"), column(batch, "n_bytes"), tokens)

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size.alias("n_bytes"))
    counted = narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), path or vocabulary_path())
