"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each document should be taken ``e`` times on average. ``floor(e)`` copies are certain; the rest is its inclusion
probability p in a sample of fixed size. Documents are ranked by random odds over inclusion odds, u/(1-u) : p/(1-p), and
taken in this order until the words of the source reach what its target leaves after the certain copies: the size that
is fixed is counted in words, as targets are. The random number comes from a hash of the id, so reruns agree.

No source is sorted as a whole. Ranks fall into 4096 bins, the words of a bin are summed, and only the bin in which the
target is reached is cut again into 4096 and then sorted. What a source takes is thereby a single cut point, and each
document is decided by comparing its rank with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import read_table
from demandspark.session import materialise

BINS = 4096
#: Columns that the operator adds; input columns of these names are replaced.
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, newline, vertical tab, form feed, carriage return; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ticket(seed: str) -> Column:
    """What a document is drawn by: its id, or its text where it has none."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    return F.concat(F.lit(f"{seed}:"), own)


def uniform(key: Column) -> Column:
    """A number within (0, 1) from the first 52 bits of a hash."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_copies: int) -> DataFrame:
    """``(source, source_size, target)``: weights repeat over the sources in code point order, null last.

    The budget is shared by weight, and targets stop at ``max_copies`` times the source; what is over is shared again
    among the others. In order of the share at which a source fills up, the filled sources come first: the common level
    is found from running sums, without iterating.
    """
    per = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    # One row per source from here on.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    per = per.withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here_on = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(here_on),
    )
    per = per.withColumn("filled", F.col("weight") * F.col("level") >= F.col("cap"))
    # The level of the first source that does not fill up holds for it and all after it.
    level = F.first(F.when(~F.col("filled"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def first_open(rows: DataFrame, bin_of: Column, max_copies: int) -> DataFrame:
    """The heaviest bin of weights, per source, that ``max_copies`` of all its documents would not fit into the target.

    ``rows`` carry ``_above``, the words of heavier documents that are full, and ``_below``, the weighted words of all
    lighter ones. Documents of weight w are full if the target holds what the level ``max_copies / w`` would take.
    """
    bins = rows.groupBy("source", bin_of.alias("_bin")).agg(
        F.sum("_size").alias("_words"), F.sum(F.col("_w") * F.col("_size")).alias("_mass"), F.min("_w").alias("_low"),
        F.max("_w").alias("_high"), *[F.first(c).alias(c) for c in ("_above", "_below", "target")],
    )
    order = Window.partitionBy("source").orderBy(F.col("_bin").desc())
    above = F.col("_above") + F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.col("_below") + F.coalesce(F.sum("_mass").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    bins = bins.withColumns({"_above": above, "_below": below})
    takes = max_copies * (F.col("_above") + F.col("_words") + F.col("_below") / F.col("_low"))
    found = F.max_by(F.struct("_bin", "_above", "_below", "_mass", "_low", "_high"), "_bin")
    out = bins.where(takes > F.col("target")).groupBy(F.col("source").alias("_s")).agg(found.alias("_open"))
    return materialise(out.select("_s", "_open.*"), "open")


def with_levels(targets: DataFrame, sizes: DataFrame, max_copies: int) -> DataFrame:
    """``targets`` plus ``level``, the copies per unit of weight at which the documents of a source, none taken more than
    ``max_copies`` times, reach its target; null where even all full ones do not.

    What the heaviest documents may not take is thereby shared by weight among the others. The lightest full weight is
    searched within bins of equal ratio, then within 4096 bins, then among the weights that are left: no source is sorted.
    """
    on = F.col("source").eqNullSafe(F.col("_s"))
    rows = sizes.where((F.col("_w") > 0) & (F.col("_size") > 0)).select("source", "_size", "_w")
    rows = rows.join(targets.select(F.col("source").alias("_s"), "target"), on).drop("_s")
    octave = F.floor(F.log2("_w") * 8)
    at = first_open(rows.withColumns({"_above": F.lit(0).cast("long"), "_below": F.lit(0.0)}), octave, max_copies)
    rows = rows.join(at, on & (octave == F.col("_bin"))).drop("_s", "_bin")
    fine = F.least(F.floor(F.coalesce(F.try_divide(F.col("_w") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * BINS), F.lit(BINS - 1))
    rows = rows.select("source", "_size", "_w", "target", "_above", "_below", fine.alias("_fine"))
    at = first_open(rows, F.col("_fine"), max_copies)
    rows = rows.drop("_above", "_below").join(at, on & (F.col("_fine") == F.col("_bin"))).drop("_s", "_bin")
    at = first_open(rows, F.col("_w"), max_copies)
    level = (F.col("target") - max_copies * F.col("_above")) / (F.col("_mass") + F.col("_below"))
    out = targets.join(at, on, "left").withColumn("level", level)
    return materialise(out.select(*targets.columns, "level"), "levels")


def ranked(rows: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """Adds ``_certain`` copies and the rank ``_x`` within (0, 1): the odds u/(1-u) over the odds p/(1-p), as a share;
    null where nothing is left to draw."""
    on = targets.withColumnRenamed("source", "_source")
    out = rows.join(on, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    if "level" in targets.columns:
        wanted = F.when(F.col("_w") > 0, F.coalesce(F.col("level") * F.col("_w"), F.lit(float(max_copies))))
    else:
        wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    out = out.withColumn("_wanted", F.least(F.coalesce(wanted, F.lit(0.0)), F.lit(float(max_copies))))
    out = out.withColumn("_certain", F.floor("_wanted"))
    out = out.withColumn("_p", F.col("_wanted") - F.col("_certain"))
    stays, goes = F.col("_u") * (1 - F.col("_p")), F.col("_p") * (1 - F.col("_u"))
    return out.withColumn("_x", F.when(F.col("_p") > 0, stays / (stays + goes)))


def crossed(rows: DataFrame, by: Sequence[str], bin_of: Column, quota: DataFrame) -> DataFrame:
    """Per source the bin in which its words reach the rest of its target: ``(by, _bin, _before)``, at most one row each."""
    bins = rows.groupBy(*by, bin_of.alias("_bin")).agg(F.sum("_size").alias("_words"), F.first("_base").alias("_base"))
    # At most BINS rows per source.
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_words").over(before), F.lit(0)))
    rest = quota.select(F.col("source").alias("_s"), "_rest")
    bins = bins.join(rest, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    hit = (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words"))
    return materialise(bins.where(hit).select(*by, "_bin", "_before", "_rest"), "bins")


def cut_points(sizes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """``targets`` plus ``_cut``, the last ``(x, tie)`` that is drawn; null where all are."""
    rows = materialise(ranked(sizes, targets, max_copies).select("source", "_size", "_tie", "_certain", "_x", "target"), "ranks")
    quota = rows.groupBy("source").agg(
        F.greatest(F.max("target") - F.sum(F.col("_certain") * F.col("_size")), F.lit(0.0)).alias("_rest")
    )
    quota = materialise(quota, "quota")
    drawable = rows.where(F.col("_x").isNotNull()).select("source", "_size", "_tie", "_x")
    scaled = F.col("_x") * BINS
    coarse = crossed(drawable.withColumn("_base", F.lit(0)), ["source"], F.floor(scaled), quota)
    near = coarse.select(F.col("source").alias("_s"), F.col("_bin").alias("_bin0"), F.col("_before").alias("_base"))
    inside = drawable.join(near, F.col("source").eqNullSafe(F.col("_s")) & (F.floor(scaled) == F.col("_bin0"))).drop("_s")
    finer = F.floor((scaled - F.col("_bin0")) * BINS)
    fine = crossed(inside, ["source", "_bin0"], finer, quota)
    near = fine.select(F.col("source").alias("_s"), F.col("_bin").alias("_bin1"), F.col("_before").alias("_from"), "_rest")
    last = inside.join(near, F.col("source").eqNullSafe(F.col("_s")) & (finer == F.col("_bin1"))).drop("_s")
    last = last.groupBy("source", "_bin0", "_bin1", "_x", "_tie").agg(
        F.sum("_size").alias("_size"), F.first("_from").alias("_from"), F.first("_rest").alias("_rest")
    )
    upto = Window.partitionBy("source").orderBy("_x", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_from") + F.coalesce(F.sum("_size").over(upto), F.lit(0))
    # The document at the cut is drawn if the total then ends nearer to the target than without it.
    last = last.withColumn("_in", 2 * before + F.col("_size") <= 2 * F.col("_rest"))
    edge = F.struct(((F.col("_bin0") + F.col("_bin1") / BINS) / BINS).alias("x"), F.lit("").alias("tie"))
    drawn = F.when(F.col("_in"), F.struct(F.col("_x").alias("x"), F.col("_tie").alias("tie"))).otherwise(edge)
    cuts = last.groupBy(F.col("source").alias("_s")).agg(F.max(drawn).alias("_cut"))
    out = targets.join(cuts, targets["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    return materialise(out, "cuts")


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_copies: int = 2,
    seed: str = "mix", doc_weight: str | None = None,
) -> DataFrame:
    """The columns of ``docs`` plus ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies x size).

    ``doc_weight`` names a column by which the documents of a source are favoured; without it all are alike. What a
    favoured document may not take beyond ``max_copies`` is shared by weight among the others; null, negative and zero
    weights take nothing. A source misses its target by half of the document at its cut at most, unless its documents of
    positive weight cannot fill it. Null texts have size 0 and are never sampled; null
    sources are one source. Rows with the same id in a source, repeated rows included, are drawn together; rows without
    an id are drawn by their text. An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    weight = F.greatest(F.col(doc_weight).cast("double"), F.lit(0.0)) if doc_weight else F.lit(1.0)
    facts = {"_size": word_count(F.col("text")), "_u": uniform(ticket(seed)), "_tie": ticket(seed), "_w": weight}
    rows = docs.withColumns(facts)
    sizes = materialise(rows.select("source", *facts), "sizes")
    targets = materialise(source_targets(sizes, weights, budget, max_copies), "targets")
    if doc_weight:
        targets = with_levels(targets, sizes, max_copies)
    cuts = cut_points(sizes, targets, max_copies)
    drawn = ranked(rows.drop(*ADDED), cuts, max_copies)
    here = F.struct(F.col("_x").alias("x"), F.col("_tie").alias("tie"))
    picked = F.col("_x").isNotNull() & (F.col("_cut").isNull() | (here <= F.col("_cut")))
    drawn = drawn.withColumn("copies", F.col("_certain") + F.when(picked, 1).otherwise(0))
    drawn = drawn.withColumns({"size": F.col("_size"), "taken": F.col("copies") * F.col("_size")})
    return drawn.select(*[c for c in docs.columns if c not in ADDED], *ADDED)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    'mix:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
    WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * ss AS cap, (2.0::DOUBLE * ss) / w AS f FROM s),
l AS (SELECT *, ((SUM(ss) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(SUM(cap) OVER (ORDER BY f, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(w) OVER (ORDER BY f, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
t AS (SELECT source, ss, least(cap, coalesce(w * (SELECT lev FROM l WHERE w * lev < cap ORDER BY f, source NULLS LAST LIMIT 1), cap)) AS target FROM l),
r AS (SELECT d.*, t.ss, t.target, CASE WHEN t.ss > 0 THEN t.target / t.ss ELSE 0.0::DOUBLE END AS e,
    (('0x' || substr(md5(d.tie), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(e) AS k, e - floor(e) AS p FROM r),
x AS (SELECT *, CASE WHEN p > 0 THEN (u * (1 - p)) / (u * (1 - p) + p * (1 - u)) END AS x FROM p),
q AS (SELECT source, greatest(max(target) - sum(k * size), 0) AS rest FROM x GROUP BY source),
g AS (SELECT source, x, tie, sum(size) AS sz FROM x WHERE x IS NOT NULL GROUP BY ALL),
h AS (SELECT g.source, g.x, g.tie, 2 * coalesce(sum(sz) OVER (PARTITION BY g.source ORDER BY g.x, g.tie
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sz <= 2 * rest AS drawn
  FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source)
SELECT x.doc_id, x.size, x.ss AS source_size, x.target, (size * (k + CASE WHEN h.drawn THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x LEFT JOIN h ON x.source IS NOT DISTINCT FROM h.source AND x.x = h.x AND x.tie = h.tie
"""
