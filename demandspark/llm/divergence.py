"""Divergence between the sources of a language, priced by pair tasks on sorted sparse arrays.

A group is the documents of one language and source, and holds (term id, count) arrays sorted by id. Two groups meet in a
task, which intersects their arrays by galloping through the longer one and prices the terms of both, of either, and of
none: a smoothed share is never 0, so every kept term of the language counts towards every pair. Arrays are cut into
chunks of term ids, which are priced apart and summed per pair, and groups are dealt in blocks, so that a task holds a
few arrays of bounded length however many terms or groups there are.

Shares are integers in billionths and all arithmetic on them is exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import batch_of, column, read_table, texts
from demandspark.session import materialise

#: Bytes of text that are cut into terms at a time.
WINDOW = 1 << 20
#: Counts that a task gathers before it hands them on.
GATHERED = 1 << 20
#: Terms of a language in one chunk, about.
CHUNK_TERMS = 1 << 15
#: Groups in a block; a task prices the pairs of two blocks.
BLOCK_GROUPS = 16
#: Needles that gallop together.
STRIDE = 512
#: Added to every count; shares are in parts of SCALE.
SMOOTHING, SCALE = 5, 1_000_000_000

TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")
GAP = re.compile(rb"[^A-Za-z\x80-\xFF]")


def terms_in(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z in lower case, in lists of bounded size; a cut falls between two terms."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + WINDOW)
        end = gap.end() if gap else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def counted_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents, added up within tasks. The empty term marks a
    group's existence, with zeros."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(held: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in sorted(held.items()):
            names = [b"", *n]
            for s in range(0, len(names), 1 << 16):
                part = names[s : s + (1 << 16)]
                same = [pa.repeat(pa.scalar(v, pa.binary()), len(part)).view(pa.string()) for v in (lang, source)]
                yield batch_of(schema, *same, pa.array(part, pa.binary()).view(pa.string()), [n[t] for t in part], [docs[t] for t in part])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(texts(batch, c) for c in ("lang", "source", "text")), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, distinct = len(n), set()
                for found in terms_in(text):
                    n.update(found)
                    distinct.update(found)
                docs.update(distinct)
                size += len(n) - before + 1
                if size >= GATHERED:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, source, term, n, n_lang, id, lead)`` for terms in at least ``min_docs`` documents of their language.

    ``n_lang`` is the language's count, ``id`` a number of the term, ``lead`` true in one row of each term. Rows with
    the empty term name the groups. One shuffle by (language, term) serves sums, document frequencies and ids.
    """
    by_term = Window.partitionBy("lang", "term")
    dealt = counted_terms(docs).repartition("lang", "term")
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumn("row", F.monotonically_increasing_id())
    sums = {"n_lang": F.sum("n").over(by_term), "df": F.sum("docs").over(by_term), "id": F.min("row").over(by_term)}
    kept = counts.withColumns(sums).where((F.col("df") >= min_docs) | (F.col("term") == ""))
    kept = kept.withColumn("lead", (F.col("row") == F.col("id")) & (F.col("term") != ""))
    return materialise(kept.select("lang", "source", "term", "n", "n_lang", "id", "lead"), "terms")


def group_table(kept: DataFrame) -> DataFrame:
    """``(lang, source, size, lang_size, vocabulary, number)``: one row per group, numbered from 0 in its language."""
    langs = kept.groupBy(F.col("lang").alias("l")).agg(
        F.sum("n").alias("lang_size"), F.sum(F.col("lead").cast("long")).alias("vocabulary")
    )
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = per.join(langs, F.col("lang") == F.col("l")).drop("l").withColumn("number", number)
    return materialise(groups, "groups")


def share(count: str, size: str) -> Column:
    """``1 + floor(SCALE * (count + SMOOTHING) / (size + SMOOTHING * vocabulary))`` of columns, exact in decimals."""
    above = f"cast({count} + {SMOOTHING} as decimal(20,0)) * {SCALE}"
    return F.expr(f"1 + ({above}) div cast({size} + {SMOOTHING} * vocabulary as decimal(20,0))")


def shares(counts: np.ndarray, size: int, vocabulary: int) -> np.ndarray:
    """The same for an array, by long division in three digits at a time: exact up to 9e15 occurrences."""
    below = max(1, size + SMOOTHING * vocabulary)
    out, rest = np.zeros(len(counts), np.int64), counts + SMOOTHING
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest %= below
    return out + 1


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two sorted arrays of distinct ids where both hold the same.

    Runs of the shorter array gallop: the bracket in the longer one starts where the last run ended and doubles until it
    reaches beyond the run, and only the bracket is searched.
    """
    if len(a) > len(b):
        there, here = overlap(b, a)
        return here, there
    low, mine, other = 0, [], []
    for s in range(0, len(a), STRIDE):
        run = a[s : s + STRIDE]
        step, high = STRIDE, min(low + STRIDE, len(b))
        while high < len(b) and b[high - 1] < run[-1]:
            step *= 2
            high = min(high + step, len(b))
        at = low + np.searchsorted(b[low:high], run)
        hit = np.flatnonzero(at < high)
        hit = hit[b[at[hit]] == run[hit]]
        mine.append(s + hit)
        other.append(at[hit])
        low = int(at[-1])
    none = np.zeros(0, np.int64)
    return (np.concatenate(mine), np.concatenate(other)) if mine else (none, none)


class Group:
    """One group's array within a chunk, with the shares of its counts and of a count of 0."""

    def __init__(self, number: int, ids: np.ndarray, counts: np.ndarray, size: int, vocabulary: int):
        self.number, self.ids, self.share = number, ids, shares(counts, size, vocabulary)
        self.none = int(shares(np.zeros(1, np.int64), size, vocabulary)[0])


def price(a: Group, b: Group) -> tuple[int, int]:
    """The sum of share differences over the terms that either holds, and their number."""
    i, j = overlap(a.ids, b.ids)
    both = np.abs(a.share[i] - b.share[j]).sum()
    only_a, only_b = np.abs(a.share - b.none), np.abs(b.share - a.none)
    total = both + only_a.sum() - only_a[i].sum() + only_b.sum() - only_b[j].sum()
    return int(total), len(a.ids) + len(b.ids) - len(i)


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, priced, held)`` for every pair of group numbers of a language, a < b: share differences over the
    terms that either holds, and how many these are."""
    largest = groups.agg(F.max("vocabulary")).first()[0] or 0
    n_chunks = max(1, -(-largest // CHUNK_TERMS))
    facts = groups.select("lang", "source", "number", "size", "vocabulary")
    chunk = F.pmod(F.xxhash64("id"), F.lit(n_chunks)).cast("int")
    cells = kept.where("term != ''").select("lang", "source", F.struct("id", "n").alias("entry"), chunk.alias("chunk"))
    cells = cells.join(facts, ["lang", "source"])
    # Every group is present in every chunk: where it holds nothing, others' terms are priced against its share of 0.
    every = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
    frame = facts.select("*", F.lit(None).cast("struct<id: bigint, n: bigint>").alias("entry"), every)
    cells = cells.unionByName(frame)
    arrays = cells.groupBy("lang", "number", "size", "vocabulary", "chunk").agg(F.array_sort(F.collect_list("entry")).alias("terms"))
    block = F.floor(F.col("number") / BLOCK_GROUPS).cast("int")
    arrays = arrays.withColumns({"block": block, "ids": F.col("terms.id"), "counts": F.col("terms.n")}).drop("terms")
    blocks = groups.groupBy("lang").agg(F.max(block).alias("last"))
    arrays = materialise(arrays, "arrays").join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    tasks = arrays.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")}).drop("other", "last")
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("priced", pa.int64()), ("held", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        lang, first, second = (table.column(c)[0].as_py() for c in ("lang", "b1", "b2"))
        sides: dict[int, list[Group]] = {first: [], second: []}
        flat = [[x.values.to_numpy() for x in table.column(c)] for c in ("ids", "counts")]
        for row, ids, counts in zip(table.select(["number", "block", "size", "vocabulary"]).to_pylist(), *flat, strict=True):
            sides[row["block"]].append(Group(row["number"], ids, counts, row["size"], row["vocabulary"]))
        out = []
        for a in sides[first]:
            for b in sides[second]:
                if first != second or a.number < b.number:
                    out.append((lang, a.number, b.number, *price(a, b)))
        return pa.Table.from_batches([batch_of(schema, *(list(zip(*out, strict=True)) or [[]] * 5))], schema)

    merged = tasks.groupBy("lang", "chunk", "b1", "b2").applyInArrow(run, "lang string, a int, b int, priced long, held long")
    return merged.groupBy("lang", "a", "b").agg(F.sum("priced").alias("priced"), F.sum("held").alias("held"))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` both ways for every two sources of a language."""
    zero = groups.withColumn("zero", F.when(F.col("vocabulary") > 0, share("0", "size")).otherwise(0))
    left = zero.select("lang", F.col("number").alias("a"), F.col("source").alias("sa"), F.col("zero").alias("za"), "vocabulary")
    right = zero.select("lang", F.col("number").alias("b"), F.col("source").alias("sb"), F.col("zero").alias("zb"))
    pairs = pair_sums(kept, groups).join(left, ["lang", "a"]).join(right, ["lang", "b"])
    absent = (F.col("vocabulary") - F.col("held")) * F.abs(F.col("za") - F.col("zb"))
    both = F.explode(F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item"))))
    valued = pairs.select("lang", (F.col("priced") + absent).alias("value"), both.alias("way"))
    return valued.select("lang", "way.source", "way.item", "value")


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for the terms that a source uses more than its language does."""
    cells = kept.where("term != ''").join(groups.drop("number"), ["lang", "source"])
    more = cells.select("lang", "source", F.col("term").alias("item"), (share("n", "size") - share("n_lang", "lang_size")).alias("value"))
    return more.where("value > 0")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far the sources of each language stand apart, and by which terms.

    Part ``pair`` has every other source of the language with the summed difference of the shares of all kept terms;
    part ``term`` the ``top`` terms whose share in the group exceeds that in its language the most. Kept are terms in at
    least ``min_docs`` documents of the language. Ranks run from 1 by value, ties by item in code point order.

    Null text, lang and source read as empty; a text without terms still makes its group exist. Repeated rows and rows
    without an id count each. A language of one source has no pairs, one without kept terms only pairs of value 0.
    Other columns are ignored, whatever their names; an empty table gives an empty result. Counts are exact up to
    9e15 occurrences a language.
    """
    kept = kept_counts(docs, min_docs)
    groups = group_table(kept)
    out = None
    for part, values, last in (("pair", pair_values(kept, groups), None), ("term", term_values(kept, groups), top)):
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = values.withColumn("rank", F.row_number().over(order)).where("rank <= %d" % last if last else "true")
        ranked = ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        out = ranked if out is None else out.union(ranked)
    return out


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n_lang) AS size FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.size), 0) AS size, coalesce(any_value(l.v), 0) AS v, any_value(l.size) AS lang_size
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL) s USING (lang, source)
  LEFT JOIN l USING (lang) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.size + 5 * g.v) AS p,
    1 + (1000000000::HUGEINT * (k.n_lang + 5)) // (g.lang_size + 5 * g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM x QUALIFY part = 'pair' OR rank <= 50
"""
