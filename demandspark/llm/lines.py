"""Line dedup with two Bloom filters.

A first pass hashes every line key and sends the hashes, packed and counted once per batch, to filter segments. A
segment runs two Bloom filters: a hash that the once-seen filter already holds goes into the twice-seen filter. A second
pass looks every line up in the twice-seen filters; only the suspected repeats are shuffled, as whole keys, to be
counted exactly and to find each key's first occurrence. False positives of the filters cost a few extra rows in that
shuffle and never change the result; there are no false negatives.

Filters that are small enough are broadcast for the second pass. Larger ones stay where they are: packed hashes are sent
to their segment, which sends the suspected ones back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import SPACES, batch_of, column, replace_columns, slices, texts, utf8
from demandspark.session import materialise

#: Bit positions per key in either filter.
PROBES = 4


def line_key(line: bytes) -> bytes:
    """The line without the white space at its ends, A-Z in lower case (bytes.lower changes ASCII letters only)."""
    return line.strip(SPACES).lower()


def code_points(key: bytes) -> int:
    return sum((c & 0xC0) != 0x80 for c in key)


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """One key per line, None for lines too short to be judged."""
    keys = (line_key(line) for line in text.split(b"\n"))
    if min_chars <= 1:
        return [k if len(k) >= min_chars else None for k in keys]
    return [k if code_points(k) >= min_chars else None for k in keys]


def positions(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """PROBES bit positions per hash, by double hashing; n_bits is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    at = hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]
    return (at & np.uint64(n_bits - 1)).astype(np.int64)


def power_of_two(n: float) -> int:
    return 1 << max(10, int(np.ceil(np.log2(max(n, 1)))))


def repeat_filters(docs: DataFrame, n_segments: int, once_bits: int, twice_bits: int, min_chars: int) -> DataFrame:
    """``(segment, bits)``: the packed twice-seen filter of every segment that saw a repeat."""
    schema = pa.schema([("segment", pa.int32()), ("single", pa.binary()), ("several", pa.binary())])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                np.array([xxhash.xxh3_64_intdigest(k) for t in texts(part) for k in set(keys_of(t, min_chars)) if k is not None], np.uint64)
                for part in slices([batch])
            ]
            hashes, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            segment = (hashes % np.uint64(n_segments)).astype(np.int32)
            rows = []
            order = np.argsort(segment, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(segment[order])) + 1) if len(order) else []:
                h, many = hashes[part], counts[part] > 1
                rows.append((segment[part[0]].item(), h[~many].tobytes(), h[many].tobytes()))
            yield batch_of(schema, *(list(zip(*rows, strict=True)) or [[], [], []]))

    def filtered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])
        for (segment,), rows in segments(batches):
            once, twice = np.zeros(once_bits, bool), np.zeros(twice_bits, bool)
            for single, several in rows:
                h, many = np.frombuffer(single, np.uint64), np.frombuffer(several, np.uint64)
                at = positions(h // np.uint64(n_segments), once_bits)
                seen = once[at].all(axis=1)
                for repeat in (h[seen], many):
                    twice[positions(repeat // np.uint64(n_segments), twice_bits)] = True
                once[at] = True
                once[positions(many // np.uint64(n_segments), once_bits)] = True
            yield batch_of(out, [segment], [np.packbits(twice, bitorder="little").tobytes()])

    packed = docs.select("text").mapInArrow(hashed, "segment int, single binary, several binary")
    packed = packed.repartition("segment").sortWithinPartitions("segment")
    return packed.mapInArrow(filtered, "segment int, bits binary")


def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[bytes, bytes]]]]:
    """Rows of a sorted stream by segment, handed on as they come: a segment's packed hashes are never held together."""
    rows = (
        (s, a, b)
        for batch in batches
        for s, a, b in zip(*(column(batch, n).to_pylist() for n in ("segment", "single", "several")), strict=True)
    )
    for segment, found in groupby(rows, key=itemgetter(0)):
        yield (segment,), ((a, b) for _, a, b in found)


def identity(batch: pa.RecordBatch) -> list[tuple]:
    """What a document is known by: whether it has no id, its id, and a hash of its text."""
    ids = column(batch, "doc_id").to_pylist()
    return [(i is None, i or 0, xxhash.xxh3_64_intdigest(t) >> 1) for i, t in zip(ids, texts(batch), strict=True)]


def found_in_segments(docs: DataFrame, filters: DataFrame, n_segments: int, n_bits: int, min_chars: int, spread: int) -> DataFrame:
    """``(no_id, id, mark, suspects)``: the hashes of a document's lines that the twice-seen filters hold.

    Hashes travel packed, once per document, with the numbers of their owners. A segment whose hashes stand in very many
    documents is spread over ``spread`` tasks by document, each with a copy of the filter, and none holds what it looks up.
    """
    # Filter rows come first within a segment and part, so their owner columns are null.
    schema = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("filter", pa.binary()), ("hashes", pa.binary()), ("owners", pa.binary())])
    ddl = "segment int, part int, filter binary, hashes binary, owners binary"
    out = pa.schema([("no_id", pa.bool_()), ("id", pa.int64()), ("mark", pa.int64()), ("hash", pa.int64())])

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = [], []
            for who, text in ((w, t) for part in slices([batch]) for w, t in zip(identity(part), texts(part), strict=True)):
                h = [xxhash.xxh3_64_intdigest(k) for k in set(keys_of(text, min_chars)) if k is not None]
                hashes.append(np.array(h, np.uint64))
                owners.append(np.tile(np.array(who, np.int64), (len(h), 1)))
            hashes, owners = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros((0, 3), np.int64)])
            segment, part = (hashes % np.uint64(n_segments)).astype(np.int64), owners[:, 2] % spread
            order = np.lexsort((part, segment))
            place = segment[order] * spread + part[order]
            rows = [
                (int(segment[at[0]]), int(part[at[0]]), None, hashes[at].tobytes(), owners[at].tobytes())
                for at in np.split(order, np.flatnonzero(np.diff(place)) + 1) if len(at)
            ]
            yield batch_of(schema, *(list(zip(*rows, strict=True)) or [[]] * 5))

    def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = None, None
        for batch in batches:
            for s, p, filter_, hashes, owners in zip(*(column(batch, n).to_pylist() for n in schema.names), strict=True):
                if filter_ is not None:
                    held, bits = (s, p), np.frombuffer(filter_, np.uint8)
                elif held == (s, p):
                    h = np.frombuffer(hashes, np.uint64)
                    hit = in_filter(bits, positions(h // np.uint64(n_segments), n_bits))
                    who = np.frombuffer(owners, np.int64).reshape(-1, 3)[hit]
                    yield batch_of(out, pa.array(who[:, 0] != 0), *[pa.array(np.ascontiguousarray(x)) for x in (who[:, 1], who[:, 2], h[hit].view(np.int64))])

    nothing = [F.lit(None).cast("binary").alias(c) for c in ("hashes", "owners")]
    parts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    copies = filters.select("segment", parts.alias("part"), F.col("bits").alias("filter"), *nothing)
    rows = copies.union(docs.mapInArrow(asked, ddl)).withColumn("_late", F.col("filter").isNull())
    rows = rows.repartition("segment", "part").sortWithinPartitions("segment", "part", "_late").drop("_late")
    hits = rows.mapInArrow(answered, "no_id boolean, id long, mark long, hash long")
    # Bounded by the lines of one document.
    return hits.groupBy("no_id", "id", "mark").agg(F.collect_set("hash").alias("suspects"))


def in_filter(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7) & 1).all(axis=1)


class Suspects:
    """The twice-seen filters of all segments, looked up for many hashes at once."""

    def __init__(self, filters: dict[int, bytes], n_segments: int, n_bits: int):
        self.n_segments, self.n_bits = n_segments, n_bits
        self.bits = np.zeros((n_segments, n_bits // 8), np.uint8)
        for segment, data in filters.items():
            self.bits[segment] = np.frombuffer(data, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        n = np.uint64(self.n_segments)
        at = positions(hashes // n, self.n_bits)
        held = self.bits[(hashes % n).astype(np.int64)[:, None], at >> 3] >> (at & 7) & 1
        return held.all(axis=1)


def suspected(batch: pa.RecordBatch, test: Suspects | None, min_chars: int) -> Iterator[list[tuple[int, bytes]]]:
    """Per document of the batch, ``(line number, key)`` of the lines that may be repeats: those that the test finds, or
    whose hashes came back from the segments with the document."""
    keys = [keys_of(t, min_chars) for t in texts(batch)]
    hashes = np.array([xxhash.xxh3_64_intdigest(k or b"") for ks in keys for k in ks], np.uint64)
    if test is None:
        returned = column(batch, "suspects").to_pylist()
        of = iter(hashes.view(np.int64).tolist())
        hit = iter([next(of) in held for ks, r in zip(keys, returned, strict=True) for held in (frozenset(r or ()),) for _ in ks])
    else:
        hit = iter(test(hashes).tolist())
    for ks in keys:
        yield [(i, k) for i, k in enumerate(ks) if next(hit) and k is not None]


def known_by(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``facts`` for their ``(no_id, id, mark)``, null where it has none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield replace_columns(batch, {"_mark": pa.array([x[2] for x in identity(batch)], pa.int64())})

    marked = docs.mapInArrow(mark, f"{fields}, _mark long")
    told = [c for c in facts.columns if c not in ("no_id", "id", "mark")]
    facts = facts.select(F.when(~F.col("no_id"), F.col("id")).alias("_id"), F.col("mark").alias("_m"), *told)
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m"))
    return marked.join(facts, on, "left").drop("_id", "_m", "_mark")


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 2,
    keep: str = "first",
    min_chars: int = 1,
    bits_per_line: int = 10,
    segment_lines: int = 1 << 20,
    broadcast_bytes: int = 64 << 20,
    spread: int = 32,
) -> DataFrame:
    """Drop lines whose key (trimmed, A-Z lower-cased) stands in at least ``min_docs`` documents.

    ``keep="none"`` drops every such line, ``keep="first"`` leaves the key's first line: the one in the document with
    the smallest ``doc_id`` (nulls last, then by text), and there the earliest. Returns the columns of ``docs`` with the
    new ``text``, plus ``n_lines`` (before) and ``n_dropped``; input columns of these two names are replaced.

    Every row is a document: repeated rows count each, and ``first`` keeps the line in all equal rows. A null or empty
    text is one empty line; a document that loses all lines keeps its row with an empty text. Keys under ``min_chars``
    code points are never dropped. An empty table gives an empty result.

    Filters, and the confirmed keys, are broadcast while they are within ``broadcast_bytes``. Beyond it, hashes are looked
    up in their segments, and suspects as well as decisions reach the documents by a join.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep must be 'first' or 'none', not {keep!r}")
    spark = docs.sparkSession
    n_lines = docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n")))).first()[0] or 0
    n_segments = max(1, -(-n_lines // segment_lines))
    per_segment = -(-n_lines // n_segments)
    once_bits, twice_bits = power_of_two(bits_per_line * per_segment), power_of_two(bits_per_line * per_segment / 4)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    filters = repeat_filters(docs, n_segments, once_bits, twice_bits, min_chars)
    test = None
    if n_segments * twice_bits // 8 <= broadcast_bytes:
        rows = filters.toLocalIterator()
        test = spark.sparkContext.broadcast(Suspects({r.segment: bytes(r.bits) for r in rows}, n_segments, twice_bits))
    else:
        suspects = found_in_segments(narrow, materialise(filters, "filters"), n_segments, twice_bits, min_chars, spread)
        # Read twice, for the counts and for the places; only documents with a suspected line are kept.
        narrow = materialise(known_by(narrow, suspects).where(F.col("suspects").isNotNull()), "suspects")

    counted = pa.schema(
        [("key", pa.binary()), ("n_docs", pa.int64()), ("no_id", pa.bool_()), ("id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32())]
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            each = (zip(identity(part), suspected(part, test and test.value, min_chars), strict=True) for part in slices([batch]))
            for who, lines in chain.from_iterable(each):
                for i, k in lines:
                    entry = found.setdefault(k, [0, (*who, i), None])
                    if entry[2] is not lines:
                        entry[0], entry[2] = entry[0] + 1, lines
                    entry[1] = min(entry[1], (*who, i))
            rows = [(k, n, *first) for k, (n, first, _) in found.items()]
            yield batch_of(counted, *(list(zip(*rows, strict=True)) or [[]] * 6))

    seen = narrow.mapInArrow(count, "key binary, n_docs long, no_id boolean, id long, mark long, line int")
    confirmed = seen.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct("no_id", "id", "mark", "line")).alias("first"))
    confirmed = materialise(confirmed.where(F.col("n_docs") >= min_docs).select("key", "first.*"), "repeats")
    held = confirmed.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    plain = docs.drop("n_lines", "n_dropped")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    first_stays = keep == "first"

    def rewritten(batch: pa.RecordBatch, dropped: list[set[int]]) -> pa.RecordBatch:
        split = [t.split(b"\n") for t in texts(batch)]
        kept = [b"\n".join([x for i, x in enumerate(ls) if i not in d] if d else ls) for ls, d in zip(split, dropped, strict=True)]
        nulls = column(batch, "text").is_null().to_pylist()
        kept = [None if n and not d else t for t, n, d in zip(kept, nulls, dropped, strict=True)]
        new = {"text": utf8(kept), "n_lines": pa.array(list(map(len, split)), pa.int64()), "n_dropped": pa.array(list(map(len, dropped)), pa.int64())}
        return replace_columns(batch, new)

    if held <= broadcast_bytes:
        table = spark.sparkContext.broadcast(
            {bytes(r.key): (r.no_id, r.id, r.mark, r.line) for r in confirmed.toLocalIterator()}
        )

        def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts = table.value
            for batch in slices(batches):
                ids = identity(batch) if first_stays else [()] * batch.num_rows
                keys = (keys_of(t, min_chars) for t in texts(batch))
                yield rewritten(
                    batch,
                    [{i for i, k in enumerate(ks) if k in firsts and not (first_stays and firsts[k] == (*who, i))} for who, ks in zip(ids, keys, strict=True)],
                )

        with_long = plain.withColumn("doc_id", F.col("doc_id").cast("long"))
        return with_long.mapInArrow(apply, f"{fields}, n_lines long, n_dropped long")

    where = pa.schema([("key", pa.binary()), ("no_id", pa.bool_()), ("id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32())])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hits = suspected(batch, test and test.value, min_chars)
            rows = [(k, *who, i) for who, lines in zip(identity(batch), hits, strict=True) for i, k in lines]
            yield batch_of(where, *(list(zip(*rows, strict=True)) or [[]] * 5))

    places = narrow.mapInArrow(place, "key binary, no_id boolean, id long, mark long, line int")
    known = confirmed.select("key", F.struct("no_id", "id", "mark", "line").alias("first"))
    drops = places.distinct().join(known, "key")
    if first_stays:
        drops = drops.where(F.struct("no_id", "id", "mark", "line") != F.col("first"))
    drops = materialise(drops.groupBy("no_id", "id", "mark").agg(F.collect_list("line").alias("_drop")), "drops")
    joined = known_by(plain.withColumn("doc_id", F.col("doc_id").cast("long")), drops)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            dropped = [set(d or ()) for d in column(batch, "_drop").to_pylist()]
            yield rewritten(batch.drop_columns(["_drop"]), dropped)

    return joined.mapInArrow(cut, f"{fields}, n_lines long, n_dropped long")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_lines(docs, min_docs=10, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, i, ls[i] AS line,
        translate(trim(ls[i], {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
bad AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
j AS (SELECT l.r, l.i, l.line, bad.k IS NOT NULL AS gone FROM l LEFT JOIN bad USING (k)),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM j GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN d USING (r)
"""
