"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector is quantised on its own, so K centroids per half give K x K cells. A query walks the cells in the
order of its summed distance to the two centroids, taken from a heap, until they hold as many entries as the budget
says; these entries are reranked by their true distance. The budget is measured: for a bounded sample of queries the
true neighbours are found by brute force, and it covers where the walk meets them.

Every row is indexed. Cells are dealt to tasks in chunks of entries and of queries, so that a cell that holds a large
part of all rows, or is visited by most queries, is no task's burden; a task sends the best few per query.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import batch_of, column, read_table, runs
from demandspark.session import materialise


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that centroids are fitted on, ``probe_sample`` the queries that the budget is measured
    with; ``coverage`` is the share of their true neighbours that the budget must reach."""

    sample: int = 8192
    probe_sample: int = 64
    coverage: float = 0.97
    cell_entries: int = 256
    max_centroids: int = 256
    rounds: int = 12
    chunk: int = 4096


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """``(vec_id, d, v)``: one packed double vector per id and length ``d``. Null and zero vectors, those with a null or
    non-finite component and rows without an id take no part; of rows that repeat an id with vectors of one length the
    smallest vector counts."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id", F.size("v").alias("d")).agg(F.min("v").alias("v"))
    out = pa.schema([("vec_id", pa.int64()), ("d", pa.int32()), ("v", pa.binary())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat, sizes = column(batch, "v").flatten().to_numpy(), column(batch, "d").to_numpy()
                parts = np.split(flat, np.cumsum(sizes)[:-1])
                yield batch_of(out, column(batch, "vec_id"), column(batch, "d"), [x.tobytes() for x in parts])

    return materialise(rows.mapInArrow(pack, "vec_id long, d int, v binary"), "vectors")


def matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's algorithm on the bounded sample, from rows spread evenly over the order of their sums."""
    c = x[np.argsort(x.sum(1), kind="stable")[np.linspace(0, len(x) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        near = squared(x, c).argmin(1)
        for i in range(k):
            if len(own := x[near == i]):
                c[i] = own.mean(0)
    return c


@dataclass
class Codebook:
    halves: tuple[np.ndarray, np.ndarray]

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.halves[0].shape[1]
        return x[:, :d], x[:, d:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (squared(part, c).argmin(1) for part, c in zip(self.split(x), self.halves, strict=True))
        return a * len(self.halves[1]) + b

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Cells by rising sum of the two distances. A pair of ranks enters the heap once both pairs before it have
        left it, so the heap stays as small as the front."""
        parts = self.split(q[None, :])
        ds = [squared(p, c)[0] for p, c in zip(parts, self.halves, strict=True)]
        orders = [np.argsort(d, kind="stable") for d in ds]
        d0, d1 = (d[o] for d, o in zip(ds, orders, strict=True))
        k0, k1 = len(d0), len(d1)
        heap, done = [(d0[0] + d1[0], 0, 0)], set()
        while heap:
            _, i, j = heapq.heappop(heap)
            done.add((i, j))
            yield int(orders[0][i]) * k1 + int(orders[1][j])
            if i + 1 < k0 and (j == 0 or (i + 1, j - 1) in done):
                heapq.heappush(heap, (d0[i + 1] + d1[j], i + 1, j))
            if j + 1 < k1 and (i == 0 or (i - 1, j + 1) in done):
                heapq.heappush(heap, (d0[i] + d1[j + 1], i, j + 1))


def fit_codebook(rows: DataFrame, n: int, s: Settings) -> Codebook:
    order = F.xxhash64(F.lit("fit"), "vec_id")
    near = rows.where(F.pmod(order, F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 1.5 * s.sample / n)) + 1))
    x = matrix([bytes(r.v) for r in near.orderBy(order, "vec_id").limit(s.sample).collect()])
    half = x.shape[1] // 2
    k = int(min(s.max_centroids, max(1, round((n / s.cell_entries) ** 0.5)), len(x)))
    return Codebook((centroids(x[:, :half], k, s.rounds), centroids(x[:, half:], k, s.rounds)))


class Best:
    """The k nearest seen so far per query, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def offer(self, query: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        diff = x - q
        score = np.sqrt((diff * diff).sum(1))
        other = ids != query
        score, ids = score[other], ids[other]
        if len(score) > self.k:
            near = score <= np.partition(score, self.k - 1)[self.k - 1]
            score, ids = score[near], ids[near]
        if query in self.held:
            score, ids = np.append(self.held[query][0], score), np.append(self.held[query][1], ids)
        order = np.lexsort((ids, score))[: self.k]
        self.held[query] = score[order], ids[order]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            q = np.repeat(list(self.held), [len(s) for s, _ in self.held.values()])
            yield batch_of(
                FOUND, pa.array(q.astype(np.int64)), pa.array(np.concatenate([i for _, i in self.held.values()])),
                pa.array(np.concatenate([s for s, _ in self.held.values()])),
            )
            self.held.clear()


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id long, vec_id long, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """The true neighbours of a bounded list of queries, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            if batch.num_rows:
                ids, x = column(batch, "vec_id").to_numpy(), matrix(column(batch, "v").to_pylist())
                for query, q in shared.value:
                    best.offer(query, np.frombuffer(q), ids, x)
        yield from best.flush()

    return ranked(rows.mapInArrow(run, FOUND_DDL), k)


def budget(index: DataFrame, asked: DataFrame, book: Codebook, counts: dict[int, int], k: int, s: Settings) -> int:
    """Entries that a walk has to reach so that ``coverage`` of the sampled queries' true neighbours lie before it."""
    order = F.xxhash64(F.lit("probe"), "vec_id")
    queries = [(r.vec_id, bytes(r.v)) for r in asked.orderBy(order, "vec_id").limit(s.probe_sample).collect()]
    true = brute_force(index, queries, k).join(index.select("vec_id", "cell"), "vec_id").select("query_id", "cell").collect()
    cells = defaultdict(list)
    for r in true:
        cells[r.query_id].append(r.cell)
    depths = []
    for query, q in queries:
        at, reached = 0, {}
        for cell in book.walk(np.frombuffer(q)):
            at += counts.get(cell, 0)
            reached[cell] = at
        depths += [reached[c] for c in cells[query]]
    if not depths:
        return sum(counts.values())
    return int(np.sort(depths)[min(len(depths) - 1, int(s.coverage * len(depths)))])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: per query the ``k`` nearest rows found by Euclidean distance, its own id
    left out, ties to the smaller id; all candidates if there are fewer.

    Which rows take part is said at ``usable``; queries are those of them that meet ``is_query``. Vectors of different
    lengths have no distance: each length has an index of its own, one after the other, so lengths are to be as few as
    the models that made the vectors. An empty table gives an empty result; other columns are ignored.
    """
    rows = usable(vectors, vector)
    parts = [
        nearest_of_length(rows.where(F.col("d") == r.d).drop("d"), r.n, is_query, k, s)
        for r in rows.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()
    ]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, parts)


def nearest_of_length(rows: DataFrame, n: int, is_query: Column, k: int, s: Settings) -> DataFrame:
    """:func:`nearest` among ``n`` packed vectors of one length."""
    spark = rows.sparkSession
    book = fit_codebook(rows, n, s)
    shared = spark.sparkContext.broadcast(book)
    placed = pa.schema([("vec_id", pa.int64()), ("cell", pa.int64()), ("v", pa.binary())])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(matrix(column(batch, "v").to_pylist()))
                yield batch_of(placed, column(batch, "vec_id"), pa.array(cells.astype(np.int64)), column(batch, "v"))

    index = materialise(rows.mapInArrow(place, "vec_id long, cell long, v binary"), "index")
    # At most max_centroids squared rows.
    counts = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}
    asked = index.where(is_query)
    entries = budget(index, asked, book, counts, k, s)
    known = spark.sparkContext.broadcast(counts)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, v in zip(column(batch, "vec_id").to_pylist(), column(batch, "v").to_pylist(), strict=True):
                cells, at = [], 0
                for cell in shared.value.walk(np.frombuffer(v)):
                    if cell in known.value:
                        cells.append(cell)
                        at += known.value[cell]
                        if at >= max(entries, k + 1):
                            break
                yield batch_of(placed, [query] * len(cells), cells, [v] * len(cells))

    probes = materialise(asked.mapInArrow(probe, "vec_id long, cell long, v binary"), "probes")
    visits = probes.groupBy("cell").agg(F.ceil(F.count("*") / s.chunk).alias("q_chunks"))
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / s.chunk).alias("e_chunks"))
    chunks = materialise(visits.join(sizes, "cell"), "chunks")

    def own(name: str) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.col(name))

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    sides = [
        df.join(chunks, "cell").select("cell", e("e_chunks").alias("e"), "*").select("cell", "e", q("q_chunks").alias("q"), F.lit(kind).alias("kind"), "vec_id", "v")
        for df, e, q, kind in ((probes, every, own, 0), (index, own, every, 1))
    ]
    both = sides[0].select("cell", "e", "q", "kind", "vec_id", "v").union(sides[1].select("cell", "e", "q", "kind", "vec_id", "v"))

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for _, part in runs(batches, ["cell", "e", "q"]):
            kind, ids = part.column("kind").to_numpy(), part.column("vec_id").to_numpy()
            at = int((kind == 0).sum())
            values = part.column("v").to_pylist()
            if 0 < at < len(kind):
                x = matrix(values[at:])
                for query, q in zip(ids[:at].tolist(), values[:at], strict=True):
                    best.offer(query, np.frombuffer(q), ids[at:], x)
                if len(best.held) > 4 * s.chunk:
                    yield from best.flush()
        yield from best.flush()

    dealt = both.repartition("cell", "e", "q").sortWithinPartitions("cell", "e", "q", "kind")
    found = ranked(dealt.mapInArrow(rerank, FOUND_DDL), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
