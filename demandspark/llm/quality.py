"""Quality rules with risk-controlled thresholds.

Every rule measures one number per document. Labelled documents are split in two by their id: the first part proposes
cutoffs for every rule and stratum, the second part, the holdout, tests them. The proposals form a fixed path of nested
rule sets, from loose to strict: one rule after the other is added at its loosest cutoff, then tightened. A rule set is
certified if the exact binomial test says that all its rules together reject at most a share ``risk`` of the stratum's
good documents. Sets are tested along the path until one fails, which needs no correction for their number; the level
``delta`` is divided among the strata (Bonferroni). The last certified set is used, none where the first one fails. With
probability ``1 - delta`` at least, all strata at once keep a share of ``1 - risk`` of their good documents.

A stratum needs ``log(delta / strata) / log(1 - risk)`` good holdout documents for its first certificate: 90 with five
strata and the default risk.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import SPACES, batch_of, column, read_table, replace_columns, slices, texts
from demandspark.session import materialise

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The rules: a document is rejected by a rule when its value is above the cutoff.
RULES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share")
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
#: Shares of the good documents of the fitting part at which cutoffs are proposed, from loose to strict.
QUANTILES = (1.0, 0.999, 0.995)


def repeated_words(words: list[bytes]) -> int:
    """Number of words inside three-word windows that stand in the text twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    # Numbering the pairs first keeps the third factor within 64 bits for any text.
    _, pairs = np.unique(pairs, return_inverse=True)
    _, window, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple:
    """The five counts of the contract, then the values of the rules."""
    words = text.split()  # of bytes: splits at space, tab, newline, vertical tab, form feed and carriage return only
    n = len(words)
    solid = text.translate(None, SPACES)
    chars = len(solid.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = repeated = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            repeated += line in seen
            seen.add(line)
    again = repeated_words(words)
    upper = len(solid) - len(solid.translate(None, UPPER))
    values = (symbols / max(n, 1), again / max(n, 1), repeated / max(lines, 1), upper / max(chars, 1))
    return (n, chars, symbols, repeated, again, *values)


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` plus the counts (long) and rule values (double); a null text counts as empty. Input columns of these
    names are replaced."""
    plain = docs.drop(*MEASURES, *RULES)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(zip(*map(measure, texts(batch)), strict=True)) or [[]] * (len(MEASURES) + len(RULES))
            new = {m: pa.array(v, pa.int64()) for m, v in zip(MEASURES, rows, strict=False)}
            new |= {r: pa.array(v, pa.float64()) for r, v in zip(RULES, rows[len(MEASURES) :], strict=True)}
            yield replace_columns(batch, new)

    return plain.mapInArrow(run, ", ".join([fields, *[f"{m} long" for m in MEASURES], *[f"{r} double" for r in RULES]]))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial distribution, summed exactly term by term."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    start = math.lgamma(n + 1)
    return math.fsum(
        math.exp(start - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q) for i in range(k + 1)
    )


def smallest_failures(n: int, p: float, level: float) -> int:
    """The largest number of rejected good documents that still certifies a cutoff; -1 if none does."""
    low, high = -1, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if binomial_tail(mid, n, p) <= level else (low, mid)
    return low


def certified_cutoffs(
    labelled: DataFrame, stratum: str, risk: float, delta: float, quantiles: Sequence[float]
) -> DataFrame:
    """``(stratum, cut_<rule>...)``, one row per stratum of labelled documents; a cutoff that is not certified is null.

    ``labelled`` holds the rule values, the stratum, ``good`` (boolean) and ``_holdout`` (boolean).
    """
    shares = sorted(map(float, quantiles), reverse=True)
    path = [(r, i) for i in range(len(shares)) for r in RULES]
    fit = labelled.where(~F.col("_holdout") & F.col("good"))
    proposed = fit.groupBy(stratum).agg(*[F.percentile_approx(r, shares, 10000).alias(f"grid_{r}") for r in RULES])
    # One row per stratum and a few numbers per rule. Settled, as the sketch can differ when it is computed anew.
    proposed = materialise(proposed, "cutoffs").withColumnRenamed(stratum, "_stratum")
    held = labelled.where(F.col("_holdout") & F.col("good"))
    tested = held.join(proposed, held[stratum].eqNullSafe(F.col("_stratum")))
    # The sets are nested, so a document is rejected from its first rejecting step on.
    first = F.least(*[F.when(F.col(r) > F.get(F.col(f"grid_{r}"), i), F.lit(k)) for k, (r, i) in enumerate(path)])
    counts = tested.withColumn("_first", first).groupBy(F.col("_stratum").alias("stratum")).agg(
        F.count("*").alias("n"),
        F.array(*[F.count_if(F.col("_first") <= k) for k in range(len(path))]).alias("rejected"),
        *[F.first(f"grid_{r}").alias(f"grid_{r}") for r in RULES],
    )
    counts = materialise(counts, "rejections")
    level = delta / max(1, counts.count())

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts: dict[str, list] = {rule: [] for rule in RULES}
            for r in batch.to_pylist():
                most = smallest_failures(r["n"], risk, level)
                certified = path[: sum(n <= most for n in r["rejected"])]
                for rule in RULES:
                    cuts[rule].append(min((r[f"grid_{rule}"][i] for name, i in certified if name == rule), default=None))
            columns = {f"cut_{rule}": pa.array(found, pa.float64()) for rule, found in cuts.items()}
            yield pa.RecordBatch.from_pydict({"_stratum": column(batch, "stratum"), **columns})

    kind = counts.schema["stratum"].dataType.simpleString()
    return counts.mapInArrow(decide, f"_stratum {kind}, " + ", ".join(f"cut_{r} double" for r in RULES))


def learn_cutoffs(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05,
    quantiles: Sequence[float] = QUANTILES,
) -> DataFrame:
    """Cutoffs per stratum from ``labels`` (``doc_id``, ``quality``); a document with several labels is good if all are 1.

    Documents that fail the base rules take no part, since the method does not judge them; null labels and labels
    without a document neither. Three tenths of the labelled ids, by their CRC, propose, the others test.
    """
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    narrow = measured.select("doc_id", F.col(stratum).alias("_in"), base_failed().alias("_base"), *RULES)
    labelled = narrow.where(~F.col("_base")).join(good, "doc_id")
    part = F.crc32(F.concat(F.lit("part "), F.col("doc_id").cast("string"))) % 10
    return certified_cutoffs(labelled.withColumn("_holdout", part >= 3), "_in", risk, delta, quantiles)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``base_failed`` and ``kept``: false if the base rules fail or a rule's value is above its certified cutoff."""
    # One row per stratum. No hint: Spark broadcasts the written table if its size allows it.
    cutoffs = materialise(cutoffs, "certified")
    joined = measured.drop("base_failed", "kept").join(cutoffs, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    over = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    rejected = reduce(lambda a, b: a | b, over)
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}).drop(*cutoffs.columns)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **learning) -> DataFrame:
    """The columns of ``docs`` plus measures, rule values, ``base_failed`` and ``kept`` (never null), one row per row.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. A null stratum is a
    stratum of its own. In a stratum without enough labels nothing is certified and only the base rules reject.
    """
    narrow = materialise(with_measures(docs.select("doc_id", stratum, "text")).drop("text"), "measures")
    return with_verdict(with_measures(docs), learn_cutoffs(narrow, labels, stratum, **learning), stratum)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = materialise(with_measures(docs).drop("text"), "measures")
    out = with_verdict(measured, learn_cutoffs(measured, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", *MEASURES, "base_failed", "kept")
