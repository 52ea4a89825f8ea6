"""N-gram Jaccard join by vertical partitioning.

A document is the set of its n-word shingles, hashed to 54 bits; the order of the hashes is the global n-gram order, and
cutting it gives fragments. Work goes fragment by fragment and partial counts are summed, in three rounds:

1. In the fragments at the head of the order, count for every set how many of its n-grams another set holds too. A set
   with more unmatched ones there than a partner may lack has no partner. Most sets end here.
2. The sets that are left send their n-grams to all fragments, and keep those that another set holds. Only these can
   overlap. Sets that share one of the first few (a prefix, so no pair is missed) form families.
3. Families are cut into blocks. For a pair of blocks every fragment counts its part of the overlaps as a matrix; the
   matrices are summed per pair of documents and compared with the threshold. Of the links only a spanning forest
   leaves the task, so that large groups of near copies give few rows, and blocks that are already connected are not
   compared any more. Where links are counted or listed, all pairs of blocks are compared instead (``compare_all``), and
   a fragment's matrix has numbers only for the pairs that bounds on the overlap leave open.

Equal sets are one class and are compared once. Links are joined to components at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import batch_of, column, components, mix64, read_table, runs, slices, texts
from demandspark.session import materialise

TOKEN_BITS = 54
#: N-grams that a task sorts at once, and that a fragment should hold.
BATCH_TOKENS = 1 << 20
#: A block holds at most 2**22 / 2**13 documents, fewer if they are long.
BLOCK_WEIGHT, DOC_WEIGHT = 1 << 22, 1 << 13
#: Sets of a component that stand for it in the second step of round 3.
SAMPLE = 8
#: About how many sets of a family its core is taken from.
CORE_SETS = 32
#: The table of approximate n-gram counts has at most 2**22 numbers of 4 bytes, sent in COUNT_PARTS parts.
MAX_SLOT_BITS, COUNT_PARTS = 22, 64
#: Fragments of the overlap counts in round 3.
VERIFY_FRAGMENTS = 4
CACHE_WORDS = 1 << 17
_codes: dict[bytes, int] = {}


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word; frequent words are remembered by the Python worker."""
    known = _codes
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct n-grams of a text (A-Z lower-cased) as 54-bit numbers; of a shorter text the whole sequence
    as one; none without words."""
    words = text.lower().split()  # of bytes: ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words)) >> (64 - TOKEN_BITS)], np.uint64)
    codes = word_codes(words)
    last = len(codes) - n + 1
    h = codes[:last]
    for k in range(1, n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : last + k])
    return np.unique(h >> np.uint64(64 - TOKEN_BITS))


def name_of(tokens: np.ndarray) -> int:
    """The class of a set. With 64 bits, two different ones among 10**9 share a name with a chance of 1 in 37."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed(n: int, percent: int) -> int:
    """Shared n-grams that a set of n needs at least, with any partner: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def head_share(percent: int) -> float:
    """The head of the order must hold more n-grams of a set than a partner may lack, with some margin for chance."""
    return min(1.0, 1.3 * (1 - percent / 100) + 0.06)


def document_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, name, n_head)``; the name is null for empty sets and rows without an id."""
    limit = int(head_share(percent) * (1 << TOKEN_BITS))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("name", pa.int64()), ("n_head", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts(batch), strict=True):
                s = shingles(text, n)
                name = name_of(s) if len(s) and doc_id is not None else None
                rows.append((doc_id, len(s), name, int(np.searchsorted(s, limit))))
            yield batch_of(schema, *(list(zip(*rows, strict=True)) or [[]] * 4))

    return docs.mapInArrow(run, "doc_id long, n_shingles long, name long, n_head long")


ASK = pa.schema(
    [("dealt", pa.int64()), ("fragment", pa.int32()), ("single", pa.binary()), ("owner", pa.binary()), ("names", pa.binary()), ("many", pa.binary())]
)
ASK_DDL = "dealt long, fragment int, single binary, owner binary, names binary, many binary"


def to_six(tokens: np.ndarray) -> bytes:
    """The low 48 bits; the fragment's number holds the others."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes, fragment: int, fragment_bits: int) -> np.ndarray:
    low = np.zeros((len(data) // 6, 8), np.uint8)
    low[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    tokens = low.view("<u8").ravel().astype(np.uint64)
    keep = np.uint64((1 << (TOKEN_BITS - fragment_bits)) - 1)
    return (tokens & keep) | np.uint64(fragment << (TOKEN_BITS - fragment_bits))


def asked(sets: Iterator[tuple[int, np.ndarray]], fragment_bits: int) -> Iterator[tuple]:
    """Rows for the fragments. N-grams that two sets of a batch share are settled here: their owners' answers (fragment
    -1) pass through, and the fragment only hears that the n-gram is shared, so a frequent one costs a row's entry per
    batch and not per document."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    names: list[int] = []
    size = 0

    def flush() -> Iterator[tuple]:
        if not held:
            return
        owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(s) for s in held])
        tokens = np.concatenate(held)
        held.clear()  # the sets are not needed twice
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        del order
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        shared = ~(new & np.append(new[1:], True))
        all_names = np.array(names, np.int64)
        # Answers to the owners of shared n-grams.
        o, t = owner[shared], tokens[shared]
        by = np.argsort(o, kind="stable")
        o, t = o[by], t[by]
        cuts = np.flatnonzero(np.diff(o)) + 1
        for part in np.split(np.arange(len(o)), cuts) if len(o) else []:
            name = all_names[o[part[0]]]
            yield int(name), -1, t[part].tobytes(), b"", name.tobytes(), b""
        # Questions about the others.
        to_fragment = np.uint64(TOKEN_BITS - fragment_bits)
        edges = np.flatnonzero(np.diff(tokens >> to_fragment)) + 1
        for start, end in zip([0, *edges], [*edges, len(tokens)], strict=True):
            t, o, s, first = tokens[start:end], owner[start:end], shared[start:end], new[start:end]
            local, index = np.unique(o[~s], return_inverse=True)
            f = int(tokens[start] >> to_fragment)
            yield f, f, to_six(t[~s]), index.astype(np.uint16).tobytes(), all_names[local].tobytes(), to_six(t[s & first])

    for name, s in sets:
        if not len(s) or name in seen:
            continue
        seen.add(name)
        # A longer set would still be taken whole; the batch then holds it alone.
        if held and (size + len(s) > BATCH_TOKENS or len(held) >= 65_535):
            yield from flush()
            held, names, size = [], [], 0
        held.append(s)
        names.append(name)
        size += len(s)
    yield from flush()


def answers(rows: pa.Table, fragment: int, fragment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(tokens, names)`` of the questions of one fragment whose n-gram is in two different sets at least."""
    tokens, names, many = [], [], []
    for single, owner, own, shared in zip(*(rows.column(c).to_pylist() for c in ("single", "owner", "names", "many")), strict=True):
        tokens.append(from_six(single, fragment, fragment_bits))
        names.append(np.frombuffer(own, np.int64)[np.frombuffer(owner, np.uint16)])
        many.append(from_six(shared, fragment, fragment_bits))
    t, s, known = np.concatenate(tokens), np.concatenate(names), np.unique(np.concatenate(many))
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    again = np.zeros(len(t), bool)
    again[1:] = (t[1:] == t[:-1]) & (s[1:] == s[:-1])
    t, s = t[~again], s[~again]
    same = t[1:] == t[:-1]
    hit = np.zeros(len(t), bool)
    hit[1:] |= same
    hit[:-1] |= same
    if len(known) and len(t):
        at = np.minimum(np.searchsorted(known, t), len(known) - 1)
        hit |= known[at] == t
    return t[hit], s[hit]


def by_name(t: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(s, kind="stable")
    t, s = t[order], s[order]
    for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1) if len(s) else []:
        yield int(s[part[0]]), t[part]


def matched_in_head(docs: DataFrame, n: int, percent: int, fragment_bits: int) -> DataFrame:
    """``(name, matched)``: how many n-grams in the head of the order another set holds too. Copies of a set in several
    tasks can add up to more than there are, which only keeps a set for round 2."""
    limit = np.uint64(int(head_share(percent) * (1 << TOKEN_BITS)))
    counted = pa.schema([("name", pa.int64()), ("matched", pa.int64())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (shingles(t, n) for batch in slices(batches) for t in texts(batch))
        yield from packed(asked(((name_of(s), s[: np.searchsorted(s, limit)].copy()) for s in sets), fragment_bits))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, rows in fragments(batches):
            if fragment < 0:
                names = np.array([np.frombuffer(x, np.int64)[0] for x in rows.column("names").to_pylist()])
                hits = np.array([len(x) // 8 for x in rows.column("single").to_pylist()])
            else:
                names, hits = np.unique(answers(rows, fragment, fragment_bits)[1], return_counts=True)
            yield batch_of(counted, pa.array(names.astype(np.int64)), pa.array(hits.astype(np.int64)))

    dealt = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(ask, ASK_DDL)
    dealt = dealt.repartition("dealt").sortWithinPartitions("fragment")
    return dealt.mapInArrow(count, "name long, matched long").groupBy("name").agg(F.sum("matched").alias("matched"))


def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of about 4 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + len(row[3]) + len(row[4]) + len(row[5]) + 64
        if size >= 4 << 20:
            yield batch_of(ASK, *zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield batch_of(ASK, *zip(*held, strict=True))


def fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """A stream sorted by fragment: the answers (-1) batch by batch as they come, then the fragments one by one."""
    batches = iter(batches)
    for batch in batches:
        n = int((column(batch, "fragment").to_numpy(zero_copy_only=False) < 0).sum())
        if n:
            yield -1, pa.Table.from_batches([batch.slice(0, n)])
        if n < batch.num_rows:
            for (fragment,), rows in runs(chain([batch.slice(n)], batches), ["fragment"]):
                yield fragment, rows


def shared_grams(docs: DataFrame, left: DataFrame, n: int, percent: int, fragment_bits: int, broadcast_bytes: int) -> DataFrame:
    """``(name, n, tokens)`` of the sets that may still have a partner: the sorted n-grams that others of ``left``
    (``name, n, doc_id``) hold too, packed; sets with too few of them are out."""
    size = left.count() * 8
    if size <= broadcast_bytes:
        ids = np.sort(np.array([r.doc_id for r in left.select("doc_id").toLocalIterator()], np.int64))
        wanted = docs.sparkSession.sparkContext.broadcast(ids)
        source = docs.where(F.col("doc_id").isNotNull())
    else:
        wanted = None
        source = docs.join(left.select("doc_id"), "doc_id", "left_semi")
    answered = pa.schema([("name", pa.int64()), ("tokens", pa.binary())])
    whole = pa.schema([("name", pa.int64()), ("tokens", pa.binary())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets() -> Iterator[tuple[int, np.ndarray]]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                if wanted is not None:
                    keep = np.isin(column(batch, "doc_id").to_numpy(zero_copy_only=False), wanted.value)
                for text in texts(batch.filter(pa.array(keep))):
                    s = shingles(text, n)
                    yield name_of(s), s

        yield from packed(asked(sets(), fragment_bits))

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, rows in fragments(batches):
            if fragment < 0:
                names = [np.frombuffer(x, np.int64)[0] for x in rows.column("names").to_pylist()]
                yield batch_of(answered, names, rows.column("single").to_pylist())
            else:
                found = [(name, t.tobytes()) for name, t in by_name(*answers(rows, fragment, fragment_bits))]
                yield batch_of(answered, *(list(zip(*found, strict=True)) or [[], []]))

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), rows in runs(batches, ["name"]):
            parts = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
            yield batch_of(whole, [name], [np.unique(np.concatenate(parts)).tobytes()])

    dealt = source.select("doc_id", "text").mapInArrow(ask, ASK_DDL).repartition("dealt").sortWithinPartitions("fragment")
    parts = dealt.mapInArrow(answer, "name long, tokens binary").repartition("name").sortWithinPartitions("name")
    held = parts.mapInArrow(assemble, "name long, tokens binary").join(left.select("name", "n"), "name")
    return held.where(F.length("tokens") / 8 >= ceil_share(F.col("n"), percent)).select("name", "n", "tokens")


def ceil_share(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def gram_counts(held: DataFrame, slots: int) -> np.ndarray:
    """About how many sets hold an n-gram: counts by hash slot, summed in each task before they are sent. It only orders
    n-grams from rare to frequent; any order that is the same for all sets gives the same links."""
    part = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    width = slots // COUNT_PARTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            for data in column(batch, "tokens").to_pylist():
                at, n = np.unique(np.frombuffer(data, np.int64) % slots, return_counts=True)
                total[at] += n.astype(np.uint32)
        if total.any():
            yield batch_of(part, list(range(COUNT_PARTS)), [total[i * width : (i + 1) * width].tobytes() for i in range(COUNT_PARTS)])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), rows in runs(batches, ["part"]):
            total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in rows.column("counts").to_pylist())
            yield batch_of(part, [number], [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()])

    ddl = "part int, counts binary"
    summed = held.mapInArrow(count, ddl).repartition("part").sortWithinPartitions("part").mapInArrow(add, ddl)
    out = np.zeros(slots, np.uint32)
    for row in summed.toLocalIterator():  # COUNT_PARTS rows, slots numbers in all
        out[row.part * width : (row.part + 1) * width] = np.frombuffer(bytes(row.counts), np.uint32)
    return out


def families(held: DataFrame, percent: int) -> DataFrame:
    """``(node, family)`` of sets that share an n-gram of their prefixes with another one, directly or in steps.

    Any pair that is similar enough shares one of the first ``held - needed + 1`` n-grams of either set, in any order
    that is the same for both. Rare ones come first here, so that sets are not tied together by common passages.
    """
    n_grams = held.agg(F.sum(F.length("tokens") / 8)).first()[0] or 1
    slots = 1 << int(min(MAX_SLOT_BITS, max(16, np.ceil(np.log2(n_grams)))))
    counts = held.sparkSession.sparkContext.broadcast(gram_counts(held, slots))
    out = pa.schema([("token", pa.int64()), ("name", pa.int64())])

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, names = [], []
            for name, n, data in zip(*(column(batch, c).to_pylist() for c in ("name", "n", "tokens")), strict=True):
                t = np.frombuffer(data, np.int64)
                t = t[np.lexsort((t, counts.value[t % slots]))[: len(t) - needed(n, percent) + 1]]
                tokens.append(t)
                names.append(np.full(len(t), name, np.int64))
            yield batch_of(out, *[pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (tokens, names)])

    pairs = held.mapInArrow(prefixes, "token long, name long")
    # A star around the smallest name of each n-gram: as many links as there are rows, not pairs.
    first = F.first("name").over(Window.partitionBy("token").orderBy("name"))
    stars = pairs.withColumn("first", first).where("name != first").select("name", "first").distinct()
    return components(stars, "name", "first", "family")


def in_blocks(members: DataFrame, *order: str) -> DataFrame:
    """``members`` (``family, name, n``) with the number of their block: neighbours in the order within their family."""
    before = Window.partitionBy("family").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.coalesce(F.sum(F.col("n") + DOC_WEIGHT).over(before), F.lit(0))
    return materialise(members.withColumn("block", F.floor(weight / BLOCK_WEIGHT)), "blocks")


def sides(held: DataFrame, placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(family, b1, b2, side, name, n, tokens)``: every set in each pair of blocks that it is to be compared in."""
    wanted = pairs.select("family", "b1", "b2", F.lit(0).alias("side"), F.col("b1").alias("block")).union(
        pairs.where("b1 < b2").select("family", "b1", "b2", F.lit(1), F.col("b2"))
    )
    where = placed.select("family", "name", "block").join(wanted, ["family", "block"]).drop("block")
    return held.join(where, "name").select("family", "b1", "b2", "side", "name", "n", "tokens")


def within_blocks(placed: DataFrame) -> DataFrame:
    several = placed.groupBy("family", "block").count().where("count > 1")
    return materialise(several.select("family", F.col("block").alias("b1"), F.col("block").alias("b2")), "pairs")


def with_part(members: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``part``, the component by the links so far, for the families that are not yet one component."""
    roots = components(links, "a", "b", "part").withColumnRenamed("node", "name")
    parted = members.join(roots, "name", "left").withColumn("part", F.coalesce("part", "name"))
    parted = materialise(parted, "parts")
    open_ = parted.groupBy("family").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("family")
    return materialise(parted.join(open_, "family", "left_semi"), "open")


def find_links(held: DataFrame, family: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links that connect all sets that are similar, directly or in steps.

    First the sets of a block are compared with each other, then some of each component that this gives, and at last, in
    families that are still apart, all blocks whose sets are of several components. Large groups of near copies fall
    into one component in the first two steps, whose cost grows with the number of sets and not of pairs.
    """
    members = held.select("name", "n").join(family.withColumnRenamed("node", "name"), "name")
    placed = in_blocks(members, "n", "name")
    links = materialise(similar(sides(held, placed, within_blocks(placed)), percent), "links")
    apart = with_part(members, links)
    nth = F.row_number().over(Window.partitionBy("family", "part").orderBy(F.xxhash64("name"), "name"))
    some = apart.withColumn("nth", nth).where(F.col("nth") <= SAMPLE).select("family", "name", "n")
    placed = in_blocks(some, "n", "name")
    links = links.union(materialise(similar(sides(held, placed, within_blocks(placed)), percent), "links"))
    placed = in_blocks(with_part(members, links), "part", "n", "name")
    ends = placed.groupBy("family", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("part").alias("first"), F.max("part").alias("last")
    )
    one, two = (ends.select("family", *[F.col(c).alias(f"{c}{i}") for c in ("block", "low", "high", "first", "last")]) for i in (1, 2))
    sized = (F.col("low2") * percent <= F.col("high1") * 100) & (F.col("low1") * percent <= F.col("high2") * 100)
    mixed = F.least("first1", "first2") != F.greatest("last1", "last2")
    pairs = one.join(two, "family").where((F.col("block1") <= F.col("block2")) & sized & mixed)
    pairs = materialise(pairs.select("family", F.col("block1").alias("b1"), F.col("block2").alias("b2")), "pairs")
    return links.union(materialise(similar(sides(held, placed, pairs), percent), "links"))


def similar(placed: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links between the sets of :func:`sides`, a spanning forest of them per pair of blocks."""
    cut = pa.schema(
        [("family", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("fragment", pa.int32()), ("side", pa.int32()),
         ("name", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())]
    )
    counted = pa.schema(
        [("family", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("rows", pa.binary()), ("cols", pa.binary()), ("counts", pa.binary())]
    )
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    step = 1 << (TOKEN_BITS - (VERIFY_FRAGMENTS.bit_length() - 1))
    borders = np.arange(1, VERIFY_FRAGMENTS, dtype=np.uint64) * np.uint64(step)

    def into_fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = []
                for r in batch.slice(start, 512).to_pylist():
                    t = np.frombuffer(r["tokens"], np.uint64)
                    for k, part in enumerate(np.split(t, np.searchsorted(t, borders))):
                        rows.append((r["family"], r["b1"], r["b2"], k, r["side"], r["name"], r["n"], part.tobytes()))
                yield batch_of(cut, *zip(*rows, strict=True))

    def overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, b1, b2, _), rows in runs(batches, ["family", "b1", "b2", "fragment"]):
            side = rows.column("side").to_numpy()
            who = np.stack([rows.column("name").to_numpy(), rows.column("n").to_numpy()], axis=1)
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
            left = np.flatnonzero(side == 0)
            right = left if b1 == b2 else np.flatnonzero(side == 1)
            ours = [sets[i] for i in left]
            counts = overlap_counts(ours, ours if b1 == b2 else [sets[i] for i in right])
            yield batch_of(counted, [family], [b1], [b2], [who[left].tobytes()], [who[right].tobytes()], [counts.tobytes()])

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, b1, b2), rows in runs(batches, ["family", "b1", "b2"]):
            left = np.frombuffer(rows.column("rows")[0].as_py(), np.int64).reshape(-1, 2)
            right = np.frombuffer(rows.column("cols")[0].as_py(), np.int64).reshape(-1, 2)
            total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in rows.column("counts").to_pylist())
            total = total.reshape(len(left), len(right))
            union = left[:, 1][:, None] + right[:, 1][None, :] - total
            a, b = np.nonzero(100 * total >= percent * union)
            if b1 == b2:
                a, b = a[a < b], b[a < b]
            found = forest(left[a, 0], right[b, 0])
            yield batch_of(linked, *(list(zip(*found, strict=True)) or [[], []]))

    key = ["family", "b1", "b2"]
    split = placed.mapInArrow(into_fragments, "family long, b1 long, b2 long, fragment int, side int, name long, n long, tokens binary")
    split = split.repartition(*key, "fragment").sortWithinPartitions(*key, "fragment", "side", "n", "name")
    partial = split.mapInArrow(overlaps, "family long, b1 long, b2 long, rows binary, cols binary, counts binary")
    return partial.repartition(*key).sortWithinPartitions(*key).mapInArrow(links, "a long, b long")


def overlap_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each pair of sets shares, as a matrix product of their incidences, some columns at a time.

    Numbers that only one set of a side and none of the other holds are left out first: sets that are not alike then
    cost little more than reading them.
    """
    out = np.zeros((len(left), len(right)), np.uint32)
    _, index = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    n = int(index.max()) + 1 if len(index) else 0
    on_left, on_right = (np.bincount(index[part], minlength=n) for part in (owner < len(left), owner >= len(left)))
    shared = (on_left > 0) & (on_right > 0) & (on_left + on_right > (2 if left is right else 1))
    keep = shared[index]
    index, owner = (np.cumsum(shared) - 1)[index[keep]], owner[keep]
    width = int(shared.sum())
    step = max(1, (1 << 22) // (len(left) + len(right)))
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    for start in range(0, width, step):
        lo, hi = np.searchsorted(index, [start, start + step])
        m = np.zeros((len(left) + len(right), min(step, width - start)), np.float32)
        m[owner[lo:hi], index[lo:hi] - start] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.uint32)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all the given links connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


def schema_of(numbers: str, binaries: str) -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in numbers.split()] + [(c, pa.binary()) for c in binaries.split()])


def ddl_of(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


PACKED = schema_of("family block", "names copies n lengths tokens")
#: A block's n-grams within a fragment; ``about`` has the numbers of :class:`Block`.
PIECE = schema_of("family block fragment", "about lengths tokens")
#: A fragment's counts for a pair of blocks; the first one also tells which blocks they are.
PARTIAL = schema_of("family b1 b2 fragment", "one two parts1 parts2 counts")
COMPARED = schema_of("family block", "names parts counts a b")


@dataclass(frozen=True)
class Block:
    """Sets of a family: names, copies, sizes, how many shared n-grams they hold, and in how many of these or of the
    family's core they and the core differ."""

    names: np.ndarray
    copies: np.ndarray
    n: np.ndarray
    held: np.ndarray
    apart: np.ndarray

    @classmethod
    def read(cls, about: bytes) -> Block:
        return cls(*np.frombuffer(about, np.int64).reshape(5, -1))


def cut_up(tokens: bytes, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(np.frombuffer(tokens, np.uint64), np.cumsum(lengths)[:-1])


def by_row(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def bounds(one: Block, two: Block, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least overlap of each two sets, 100 + percent times the overlap that a link asks for, and which pairs these
    leave open.

    With D for what a set and the core do not share, ``2 * |A & B| = |A| + |B| - |DA| - |DB| + 2 * |DA & DB|``. The last
    term lies between 0 and the smaller D, and is counted for open pairs only.
    """
    least = ((one.held - one.apart)[:, None] + (two.held - two.apart)[None, :]) // 2
    asked_for = percent * (one.n[:, None] + two.n[None, :])
    most = least + np.minimum(one.apart[:, None], two.apart[None, :])
    return least, asked_for, ((100 + percent) * least < asked_for) & ((100 + percent) * most >= asked_for)


def fragment_counts(one: Block, two: Block, ours: list[np.ndarray], theirs: list[np.ndarray], same: bool, percent: int) -> np.ndarray:
    """How many n-grams of a fragment the open pairs of two blocks share, each pair of one block once."""
    unsure = bounds(one, two, percent)[2]
    if same:
        np.fill_diagonal(unsure, False)
    rows, cols = np.flatnonzero(unsure.any(axis=1)), np.flatnonzero(unsure.any(axis=0))
    left = [ours[i] for i in rows]
    counts = overlap_counts(left, left if same else [theirs[i] for i in cols]) if len(rows) else np.zeros((0, 0), np.uint32)
    wanted = np.triu(unsure) if same else unsure
    return counts[wanted[np.ix_(rows, cols)]]


def matched(one: Block, two: Block, counts: list[np.ndarray], same: bool, percent: int) -> np.ndarray:
    """Which sets of two blocks are linked, from the sum of the counts of all fragments."""
    overlap, asked_for, unsure = bounds(one, two, percent)
    if same:
        np.fill_diagonal(unsure, False)
        unsure = np.triu(unsure)
    overlap[unsure] += sum((c.astype(np.int64) for c in counts), np.zeros(int(unsure.sum()), np.int64))
    match = (100 + percent) * overlap >= asked_for
    if same:
        match = np.triu(match, 1)
        match |= match.T
    return match


def cores(held: DataFrame, placed: DataFrame) -> DataFrame:
    """``(family, core)``: n-grams that most of some sets of a family hold, for families of several blocks. Any numbers
    would give the same links; with these, near copies are short to send."""
    out = pa.schema([("family", pa.int64()), ("core", pa.binary())])
    sizes = placed.groupBy("family").agg(F.count("*").alias("size"), F.max("block").alias("last")).where("last > 0")
    drawn = F.pmod(F.xxhash64("name"), F.lit(1 << 20)) * F.col("size") < CORE_SETS << 20
    some = placed.join(sizes, "family").where(drawn).select("family", "name")

    def core(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family,), rows in runs(batches, ["family"]):
            tokens, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]), return_counts=True)
            yield batch_of(out, [family], [tokens[2 * n > rows.num_rows].tobytes()])

    found = held.join(some, "name").select("family", "tokens").repartition("family").sortWithinPartitions("family")
    return materialise(found.mapInArrow(core, "family long, core binary"), "cores")


def compare_all(held: DataFrame, members: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """``(name, linked)``, the number of documents in other classes that a class is linked to, and ``(a, b)``, its links.

    ``members`` is ``(family, name, n, copies)``. Every block of a family is compared with itself, then with all those
    whose sizes allow a link. For a pair of blocks every fragment of the n-gram order counts its part of the overlaps in
    a task of its own; the parts are summed per pair and compared with the threshold. Counts leave a task as one number
    per set and not per link, and are summed by block. Links are all of them if ``every``, else those that connect the
    same sets.
    """
    placed = in_blocks(members, "n", "name")
    pair = ["family", "b1", "b2"]
    borders = np.arange(1, VERIFY_FRAGMENTS, dtype=np.uint64) * np.uint64((1 << TOKEN_BITS) // VERIFY_FRAGMENTS)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, block), rows in runs(batches, ["family", "block"]):
            tokens = rows.column("tokens").to_pylist()
            numbers = [rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("name", "copies", "n")]
            lengths = np.array([len(t) // 8 for t in tokens], np.int64)
            yield batch_of(PACKED, [family], [block], *[[x] for x in numbers], [lengths.tobytes()], [b"".join(tokens)])

    def into_fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in by_row(batches):
            core = np.frombuffer(row["core"] or b"", np.uint64)
            names, copies, n, lengths = (np.frombuffer(row[c], np.int64) for c in ("names", "copies", "n", "lengths"))
            apart = [np.setxor1d(t, core, assume_unique=True) if len(core) else t for t in cut_up(row["tokens"], lengths)]
            about = np.stack([names, copies, n, lengths, [len(t) for t in apart]]).astype(np.int64).tobytes()
            cuts = [np.split(t, np.searchsorted(t, borders)) for t in apart]
            for k in range(VERIFY_FRAGMENTS):
                tokens = [c[k] for c in cuts]
                sizes = np.array([len(t) for t in tokens], np.int64)
                # The first fragment also stands for the block.
                if k == 0 or sizes.any():
                    yield batch_of(PIECE, [row["family"]], [row["block"]], [k], [about], [sizes.tobytes()], [np.concatenate(tokens).tobytes()])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, b1, b2, fragment), rows in runs(batches, [*pair, "fragment"]):
            same, found = b1 == b2, rows.sort_by("side").to_pylist()
            if len(found) < 2 and not same:
                continue  # n-grams of one side only
            one, two = Block.read(found[0]["about"]), Block.read(found[-1]["about"])
            ours, theirs = (cut_up(r["tokens"], np.frombuffer(r["lengths"], np.int64)) for r in (found[0], found[-1]))
            counts = fragment_counts(one, two, ours, theirs, same, percent)
            first = [[r[c] if fragment == 0 else None] for c in ("about", "parts") for r in (found[0], found[-1])]
            if fragment == 0 or counts.any():
                yield batch_of(PARTIAL, [family], [b1], [b2], [fragment], *first, [counts.tobytes()])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, b1, b2), rows in runs(batches, pair):
            found = rows.sort_by("fragment").to_pylist()
            one, two = Block.read(found[0]["one"]), Block.read(found[0]["two"])
            match = matched(one, two, [np.frombuffer(r["counts"], np.uint32) for r in found], b1 == b2, percent)
            if b1 == b2:
                a, b = np.nonzero(np.triu(match))
                tree = np.array(forest(a, b), np.int64).reshape(-1, 2)
                a, b = (a, b) if every else tree.T
                sent = (one.names, parts_of(len(one.names), tree), weights(match, one.copies), one.names[a], one.names[b])
                yield batch_of(COMPARED, [family], [b1], *[[x.tobytes()] for x in sent])
                continue
            a, b = np.nonzero(match)
            if not every:
                # Sets of a block that are one component already are one node here.
                parts1, parts2 = (np.frombuffer(found[0][c], np.int64) for c in ("parts1", "parts2"))
                nodes = np.unique(parts1[a] * len(two.names) + parts2[b])
                a, b = np.array(forest(nodes // len(two.names), len(one.names) + nodes % len(two.names)), np.int64).reshape(-1, 2).T
                b = b - len(one.names)
            counts = [weights(match, two.copies).tobytes(), weights(match.T, one.copies).tobytes()]
            empty = [None, None]
            yield batch_of(COMPARED, [family] * 2, [b1, b2], empty, empty, counts, [one.names[a].tobytes(), b""], [two.names[b].tobytes(), b""])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, ["family", "block"]):
            names = next(np.frombuffer(x, np.int64) for x in rows.column("names").to_pylist() if x is not None)
            total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
            yield batch_of(pa.schema([("name", pa.int64()), ("linked", pa.int64())]), pa.array(names), pa.array(total))

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in by_row(batches):
            yield batch_of(pa.schema([("a", pa.int64()), ("b", pa.int64())]), *[pa.array(np.frombuffer(row[c], np.int64)) for c in ("a", "b")])

    def compared(sent: DataFrame, step: str) -> DataFrame:
        """By block: its links with the other block of each pair, and with itself."""
        sent = sent.select(*pair, "fragment", "side", "about", "lengths", "tokens", "parts")
        sent = sent.repartition(*pair, "fragment").sortWithinPartitions(*pair, "fragment", "side")
        partial = sent.mapInArrow(count, ddl_of(PARTIAL)).repartition(*pair).sortWithinPartitions(*pair)
        return materialise(partial.mapInArrow(decide, ddl_of(COMPARED)), step)

    source = held.select("name", "tokens").join(placed, "name").repartition("family", "block")
    source = source.sortWithinPartitions("family", "block", "n", "name").select("family", "block", "name", "n", "copies", "tokens")
    whole = source.mapInArrow(pack, ddl_of(PACKED)).join(cores(held, placed), "family", "left")
    pieces = materialise(whole.mapInArrow(into_fragments, ddl_of(PIECE)), "pieces")
    own = pieces.withColumns({"b1": F.col("block"), "b2": F.col("block"), "side": F.lit(0), "parts": F.lit(None).cast("binary")})
    own = compared(own, "within")
    ends = placed.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = (ends.select("family", *[F.col(c).alias(f"{c}{i}") for c in ("block", "low", "high")]) for i in (1, 2))
    sized = (F.col("low2") * percent <= F.col("high1") * 100) & (F.col("low1") * percent <= F.col("high2") * 100)
    pairs = one.join(two, "family").where((F.col("block1") < F.col("block2")) & sized)
    pairs = materialise(pairs.select("family", F.col("block1").alias("b1"), F.col("block2").alias("b2")), "pairs")
    wanted = pairs.select("*", F.lit(0).alias("side"), F.col("b1").alias("block")).union(pairs.select("*", F.lit(1), F.col("b2")))
    parts = own.select("family", "block", F.lit(0).cast("long").alias("fragment"), "parts")
    sent = pieces.join(parts, ["family", "block", "fragment"], "left")
    crossed = compared(wanted.join(sent, ["family", "block"]), "crossed")
    both = own.union(crossed)
    tallies = both.select("family", "block", "names", "counts").repartition("family", "block").sortWithinPartitions("family", "block")
    links = both.select("a", "b").where(F.length("a") > 0)
    return tallies.mapInArrow(add, "name long, linked long"), links.mapInArrow(unpack, "a long, b long")


def weights(match: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each row the sum of the copies of what it matches; exact below 2**53."""
    return (match.astype(np.float64) @ copies.astype(np.float64)).astype(np.int64)


def parts_of(n: int, tree: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one of its component, by links without a cycle."""
    parts = np.arange(n)
    for a, b in tree.tolist():
        low, high = sorted((parts[a], parts[b]))
        parts[parts == high] = low
    return parts


@dataclass(frozen=True)
class Candidates:
    """All rows with their class, the classes, and the shared n-grams and families of those that may have a partner."""

    rows: DataFrame
    classes: DataFrame
    held: DataFrame
    family: DataFrame

    def members(self) -> DataFrame:
        family = self.family.withColumnRenamed("node", "name")
        return self.held.select("name", "n").join(family, "name").join(self.classes.select("name", "copies"), "name")

    def components(self, links: DataFrame) -> DataFrame:
        """``(name, component_id)`` of all classes."""
        joined = components(links, "a", "b")
        roots = self.classes.join(joined, F.col("name") == F.col("node"), "left")
        roots = materialise(roots.select("name", "doc_id", F.coalesce("root", "name").alias("root")), "roots")
        smallest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return materialise(roots.join(smallest, "root").select("name", "component_id"), "components")


def candidates(docs: DataFrame, n: int, percent: int, broadcast_bytes: int) -> Candidates:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(document_sets(docs, n, percent), "sets")
    classes = rows.where(F.col("name").isNotNull()).groupBy("name").agg(
        F.max("n_shingles").alias("n"), F.max("n_head").alias("n_head"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    classes = materialise(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    # 48 bits of an n-gram travel; the fragment's number gives the other six or more.
    fragment_bits = min(30, max(TOKEN_BITS - 48, int(np.ceil(np.log2(max(total, 1) / BATCH_TOKENS)))))
    matched = matched_in_head(docs, n, percent, fragment_bits)
    lacking = F.col("n_head") - F.coalesce("matched", F.lit(0))
    left = classes.join(matched, "name", "left").where(lacking <= F.col("n") - ceil_share(F.col("n"), percent))
    left = materialise(left.select("name", "n", "doc_id"), "candidates")
    held = materialise(shared_grams(docs, left, n, percent, fragment_bits, broadcast_bytes), "shared")
    return Candidates(rows, classes, held, materialise(families(held, percent), "families"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    Two documents are linked if their n-word shingle sets A, B have ``100 * |A & B| >= percent * |A | B|``; the component
    is the smallest id that links lead to. A document without words, or without text, has an empty set and is its own
    component; a text of fewer words is one shingle. Repeated rows are equal sets. Rows without an id are not compared
    and have a null component. Other columns are ignored, and an empty table gives an empty result.
    """
    found = candidates(docs, n, percent, broadcast_bytes)
    named = found.components(find_links(found.held, found.family, percent))
    out = found.rows.join(named, "name", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_documents(docs: DataFrame, n: int = 5, percent: int = 80, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)``: as :func:`near_duplicates`, and how many other rows a row is
    linked to. Those with an equal set count; empty sets have none, and rows without an id a null."""
    found = candidates(docs, n, percent, broadcast_bytes)
    counts, links = compare_all(found.held, found.members(), percent, every=False)
    named = found.components(links).join(found.classes.select("name", "copies"), "name").join(counts, "name", "left")
    named = named.select("name", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = found.rows.join(materialise(named, "counted"), "name", "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), n_links)


def linked_pairs(docs: DataFrame, n: int = 5, percent: int = 80, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``(a, b)``: all links between different sets, each once, as the smallest ids of the two sets, ``a < b`` but where
    rows of different sets share an id. As many rows as links, so the square of a group's size."""
    found = candidates(docs, n, percent, broadcast_bytes)
    _, links = compare_all(found.held, found.members(), percent, every=True)
    one, two = (found.classes.select(F.col("name").alias(c), F.col("doc_id").alias(f"doc_{c}")) for c in "ab")
    named = links.join(one, "a").join(two, "b")
    return named.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id. Documents without words and
    rows without an id stay. Rows that share an id are documents of their own: a group keeps one of them, and where
    their texts are no near duplicates all stay."""
    own = "_row"
    while own in docs.columns:
        own += "_"
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1").isEmpty():
        keyed = docs.withColumn(own, F.col("doc_id"))
    else:
        # Numbers that rise with the id, and tell rows of one id apart; written, since they depend on the partitions.
        order = ["doc_id", F.xxhash64("text")]
        number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
        keyed = materialise(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, number), "numbered")
    found = near_duplicates(keyed.select(F.col(own).alias("doc_id"), "text"), **how)
    gone = found.where((F.col("component_id") != F.col("doc_id")) & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias(own))
    return keyed.join(materialise(gone, "gone"), own, "left_anti").select(docs.columns)


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked_documents(read_table(spark, sf_dir, "documents"), n=3, percent=90)
