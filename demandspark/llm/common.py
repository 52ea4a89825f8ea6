"""Helpers shared by the training-data operators: Arrow batches, sorted runs, sampling keys, links to components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandspark.session import materialise

#: Word characters of the contracts: anything but space, tab, newline, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [t or b"" for t in column(batch, name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """So that a worker turns few texts into Python objects at a time."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def utf8(values: Sequence[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def batch_of(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    made = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def replace_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns set by name; new names go to the end."""
    names = [*batch.schema.names, *[n for n in new if n not in batch.schema.names]]
    return pa.RecordBatch.from_arrays([new[n] if n in new else column(batch, n) for n in names], names)


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal integer keys of a stream that is sorted by them, one table per key.

    Only one run is held at a time.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.ones(batch.num_rows, bool)
        change[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        starts = np.flatnonzero(change)
        for s, e in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            key = tuple(v[s].item() for v in values)
            if key != held_key:
                if held:
                    yield held_key, pa.Table.from_batches(held)
                held, held_key = [], key
            held.append(batch.slice(s, e - s))
    if held:
        yield held_key, pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame, a: str, b: str, name: str = "root") -> DataFrame:
    """``(node, root)`` for every node of an undirected link table; the root is the smallest node it can reach.

    Alternates two star steps: every node is hung on the smallest node of its neighbourhood, first from its larger
    neighbours, then from its smaller ones. Each round at least halves the depth of the trees, and no step gathers a
    node's neighbours: the minimum is an aggregate, and the join back is an ordinary one. Each round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = materialise(edges, "links")
    seen = None
    while True:
        # Large star: the larger neighbours of u point to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = materialise(big.where("u != v").distinct(), "stars")
        # Small star: u and its smaller neighbours point to the smallest of them.
        low = materialise(big.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias(name)).union(
                edges.select("v", F.col("v").alias(name)).distinct()
            )
        seen = tuple(state)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
