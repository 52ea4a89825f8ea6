"""Exact ranks and quantiles without sorting a whole group in one task.

A feature can have as many distinct values as the table has rows, so neither an exact
``percentile`` (one hash map per group) nor a window over the whole feature (one task per
group) is safe. Here equal values are counted first, the value axis of every feature is cut
into slices of about equal size, and running totals are formed inside the slices with the
slice totals added on top. Slice borders only decide where work is done, not the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.session import materialise, settle


def long_values(df: DataFrame, features: Sequence[str], weights: dict[str, Column]) -> DataFrame:
    """``(feature, value, <weights>)``, one row per row and numeric column; NULL and NaN are left out. Nothing moves."""
    tagged = df.select(
        *[F.col(c).cast("double").alias(c) for c in features],
        *[w.alias(name) for name, w in weights.items()],
    )
    long = tagged.unpivot(list(weights), list(features), "feature", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    # 0.0 and -0.0 are one value.
    return long.withColumn("value", F.col("value") + F.lit(0.0))


def value_counts(df: DataFrame, features: Sequence[str], weights: dict[str, Column]) -> DataFrame:
    """``(feature, value, <weight sums>)``: equal values counted once.

    Written out, because slice totals and ranks both read it. This moves every distinct value, which running totals
    need anyway; quantiles and bins read :func:`long_values` instead.
    """
    long = long_values(df, features, weights)
    return materialise(long.groupBy("feature", "value").agg(*[F.sum(w).alias(w) for w in weights]), "values")


def add_rank(df: DataFrame, name: str, value: str, cuts: str, max_cuts: int, inclusive: bool = False) -> DataFrame:
    """Add the number of sorted cuts below the value (or not above it, when inclusive), by an unrolled
    bisection that stays in generated code."""
    out = df.withColumn(name, F.lit(0))
    for step in (2**k for k in reversed(range(max_cuts.bit_length()))):
        # get() is NULL past the end of the array, which counts as "not below".
        cut = F.get(F.col(cuts), F.col(name) + (step - 1))
        below = cut <= F.col(value) if inclusive else cut < F.col(value)
        out = out.withColumn(name, F.col(name) + F.when(below, step).otherwise(0))
    return out.drop(cuts)


def value_slices(counts: DataFrame, measures: Sequence[str], by: str, value: str, n_buckets: int) -> DataFrame:
    """One row per feature: slice borders balanced by distinct values, and the total of every measure.

    Settled, because the sketch behind the borders is not the same on every recomputation.
    """
    borders = F.percentile_approx(value, [i / n_buckets for i in range(1, n_buckets)], 20 * n_buckets)
    return settle(
        counts.groupBy(by).agg(
            F.array_distinct(borders).alias("_cuts"), *[F.sum(m).alias(f"all_{m}") for m in measures]
        )
    )


def _slice_offsets(
    counts: DataFrame, measures: Sequence[str], by: str, value: str, n_buckets: int
) -> tuple[DataFrame, DataFrame]:
    """Counts with their slice and the feature's totals ``all_<measure>``; and per slice the sum of
    every measure in it and before it, and where the next slice starts."""
    # Enough slices for every task of a wide cluster; their number never changes the result.
    n_buckets = max(n_buckets, min(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8192))
    # One row per feature and n_buckets numbers each: bounded by the schema, so broadcasting is safe.
    shape = F.broadcast(value_slices(counts, measures, by, value, n_buckets))
    sliced = add_rank(counts.join(shape, by), "_slice", value, "_cuts", n_buckets)
    per_slice = sliced.groupBy(by, "_slice").agg(
        F.min(value).alias("_first"),
        *[F.sum(m).alias(f"_sum_{m}") for m in measures],
        *[F.max(f"all_{m}").alias(f"_all_{m}") for m in measures],
    )
    # At most n_buckets rows per feature.
    across = Window.partitionBy(by).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        by,
        "_slice",
        F.lead("_first").over(across).alias("_next_first"),
        *[F.col(f"_{k}_{m}") for m in measures for k in ("sum", "all")],
        *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
    )
    return sliced, offsets


def running_totals(
    counts: DataFrame, measures: Sequence[str], by: str = "feature", value: str = "value", n_buckets: int = 256
) -> DataFrame:
    """Add ``all_<measure>`` (the feature's total), ``cum_<measure>`` (inclusive running sums in value
    order) and ``next_value``."""
    sliced, offsets = _slice_offsets(counts, measures, by, value, n_buckets)
    inside = Window.partitionBy(by, "_slice").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.join(F.broadcast(offsets), [by, "_slice"])
        .withColumns(
            {
                **{f"cum_{m}": F.sum(m).over(upto) + F.col(f"_off_{m}") for m in measures},
                "next_value": F.coalesce(F.lead(value).over(inside), F.col("_next_first")),
            }
        )
        .drop("_slice", "_next_first", *[f"_{k}_{m}" for m in measures for k in ("sum", "all", "off")])
    )


def quantiles_of_counts(
    counts: DataFrame, measure: str, probabilities: Sequence[float], by: str = "feature", value: str = "value",
    n_buckets: int = 256,
) -> DataFrame:
    """Exact linear-interpolation quantiles per feature: ``(by, n, quantiles array)``.

    ``counts`` may be rows or counted values. It is scanned for borders, for the totals of the slices, and for the
    slices that hold a wanted rank, two per probability at most: only the values of these are shuffled and sorted, and
    only those on a wanted rank collected.
    """
    sliced, offsets = _slice_offsets(counts, [measure], by, value, n_buckets)
    marks = F.array(*[F.lit(float(p)) for p in sorted(probabilities)])

    def holds_rank(total: Column, first: Column, last: Column) -> Column:
        lows = F.transform(marks, lambda p: F.floor(p * (total - 1)))
        return F.exists(lows, lambda k: (first <= k + 1) & (k <= last))

    size = F.col(f"all_{measure}")
    off, held = F.col(f"_off_{measure}"), F.col(f"_sum_{measure}")
    needed = offsets.where(holds_rank(F.col(f"_all_{measure}"), off, off + held - 1)).select(by, "_slice", off)
    near = sliced.join(F.broadcast(needed), [by, "_slice"]).groupBy(by, "_slice", value).agg(
        F.sum(measure).alias(measure), F.max(size).alias(f"all_{measure}"), F.max(off).alias(f"_off_{measure}")
    )
    upto = Window.partitionBy(by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = near.withColumn("_last", F.sum(measure).over(upto) + off - 1)
    hit = ranked.where((F.col(measure) > 0) & holds_rank(size, F.col("_last") - F.col(measure) + 1, F.col("_last")))
    spans = F.sort_array(F.collect_list(F.struct(F.col("_last").alias("last"), F.col(value).alias("v"))))
    found = hit.groupBy(by, size.alias("n")).agg(spans.alias("spans"))

    return found.select(by, "n", interpolated(probabilities).alias("quantiles"))


def interpolated(probabilities: Sequence[float]) -> Column:
    """Quantiles from ``spans``, the sorted ``(last, v)`` of values on the wanted ranks, and the number ``n`` of all."""

    def at(position: Column) -> Column:
        return F.try_element_at(F.filter("spans", lambda s: s["last"] >= position), F.lit(1))["v"]

    def blend(p: Column) -> Column:
        position = p * (F.col("n") - 1)
        low = F.floor(position)
        part = position - low
        return F.struct(at(low).alias("a"), at(F.least(low + 1, F.col("n") - 1)).alias("b"), part.alias("t"))

    def value_of(x: Column) -> Column:
        gap = x["b"] - x["a"]
        return F.when(x["t"] >= 0.5, x["b"] - gap * (1 - x["t"])).otherwise(x["a"] + gap * x["t"])

    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    return F.transform(F.transform(asked, blend), value_of)


def bracketed_quantiles(df: DataFrame, features: Sequence[str], probabilities: Sequence[float], accuracy: int = 20_000) -> DataFrame:
    """``(feature, n, quantiles, below)`` in two scans: exact quantiles, and how many values lie below each of them.

    The first scan sketches all columns at once and brackets every quantile by values that are twice the sketch's error
    away on either side. The second counts the rows between the brackets and keeps the values within them, about
    4 / accuracy of the rows per quantile; only these are shuffled and sorted, each bracket apart. The result does not
    depend on the sketch: a rank outside its bracket would be missing, and then :func:`quantiles_of_counts` is asked.
    Features without known values have no row.
    """
    spark = df.sparkSession
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    known = typed.select(*[F.when(~F.isnan(c), F.col(c) + F.lit(0.0)).alias(c) for c in features])
    error = 2.0 / accuracy
    around = [min(max(p + side * error, 0.0), 1.0) for p in probabilities for side in (-1, 1)]
    sketch = known.agg(*[F.percentile_approx(c, around, accuracy).alias(c) for c in features]).first()
    # One row per feature with two numbers per probability.
    found = [(c, sorted(sketch[c][0::2]), sorted(sketch[c][1::2])) for c in features if sketch[c] is not None]
    brackets = F.broadcast(spark.createDataFrame(found, "feature string, _lows array<double>, _highs array<double>"))
    long = known.unpivot([], list(features), "feature", "value").where("value is not null")
    k = len(probabilities)
    placed = add_rank(add_rank(long.join(brackets, "feature"), "_opened", "value", "_lows", k, inclusive=True), "_closed", "value", "_highs", k)
    kept = F.when(F.col("_opened") > F.col("_closed"), F.col("value")).alias("value")
    # Rows between two brackets become one; they come before the values of the bracket behind them.
    cells = materialise(placed.groupBy("feature", "_closed", kept).agg(F.count("*").alias("n")), "brackets")
    per = cells.groupBy("feature", "_closed").agg(F.sum("n").alias("_sum"))
    across = Window.partitionBy("feature").orderBy("_closed")
    offsets = per.select(
        "feature", "_closed", F.coalesce(F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_sum").over(Window.partitionBy("feature")).alias("all"),
    )
    upto = Window.partitionBy("feature", "_closed").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.join(F.broadcast(offsets), ["feature", "_closed"]).withColumn("last", F.sum("n").over(upto) + F.col("_off") - 1)
    marks = F.array(*[F.lit(float(p)) for p in probabilities])
    first = F.col("last") - F.col("n") + 1
    wanted = F.exists(marks, lambda p: (first <= F.floor(p * (F.col("all") - 1)) + 1) & (F.floor(p * (F.col("all") - 1)) <= F.col("last")))
    hits = ranked.where(F.col("value").isNotNull() & wanted)
    spans = F.sort_array(F.collect_list(F.struct("last", F.col("value").alias("v"), first.alias("first"))))
    found = hits.groupBy("feature", F.col("all").alias("n")).agg(spans.alias("spans"))
    below = F.transform("quantiles", lambda q: F.try_element_at(F.filter("spans", lambda s: s["v"] >= q), F.lit(1))["first"])
    out = found.withColumn("quantiles", interpolated(probabilities)).withColumn("below", below)
    # A rank between brackets shows as a neighbour of it that is not among the spans.
    lows = F.transform(marks, lambda p: F.floor(p * (F.col("n") - 1)))
    has = lambda r: F.exists("spans", lambda s: (s["first"] <= r) & (r <= s["last"]))
    missed = ~F.forall(lows, lambda r: has(r) & has(F.least(r + 1, F.col("n") - 1)))
    out = materialise(out.select("feature", "n", "quantiles", "below", missed.alias("missed")), "quantiles")
    if out.where("missed").isEmpty():
        return out.drop("missed")
    counts = value_counts(df, features, {"n_rows": F.lit(1)})
    exact = quantiles_of_counts(counts, "n_rows", probabilities)
    cuts = F.broadcast(exact.select("feature", F.array_sort("quantiles").alias("_cuts")))
    under = add_rank(counts.join(cuts, "feature"), "_bin", "value", "_cuts", k, inclusive=True).groupBy("feature", "_bin").agg(F.sum("n_rows").alias("m"))
    listed = under.groupBy("feature").agg(F.collect_list(F.struct("_bin", "m")).alias("bins"))

    def less(q: Column) -> Column:
        at = F.array_position(F.array_sort("quantiles"), q)  # bins below the first equal cut hold smaller values
        return F.aggregate("bins", F.lit(0).cast("long"), lambda acc, b: acc + F.when(b["_bin"] < at, b["m"]).otherwise(0))

    return exact.join(listed, "feature").select("feature", "n", "quantiles", F.transform("quantiles", less).alias("below"))


def exact_quantiles(df: DataFrame, features: Sequence[str], probabilities: Sequence[float], n_buckets: int = 256) -> DataFrame:
    """``(feature, n, quantiles)`` for numeric columns of any size."""
    rows = long_values(df, features, {"n_rows": F.lit(1)})
    return quantiles_of_counts(rows, "n_rows", probabilities, n_buckets=n_buckets)


def describe(df: DataFrame, features: Sequence[str], n_buckets: int = 256) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of numeric columns."""
    quartiles = exact_quantiles(df, features, [0.0, 0.25, 0.5, 0.75, 1.0], n_buckets)
    moments = (
        df.select([F.col(c).cast("double").alias(c) for c in features])
        .unpivot([], list(features), "feature", "value")
        .groupBy("feature")
        .agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )
    names = ["min", "p25", "median", "p75", "max"]
    return moments.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)]
    )
