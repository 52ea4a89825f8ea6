import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandspark.llm.quality import (
    MEASURES, QUANTILES, RULES, binomial_tail, certified_cutoffs, judge, measure, smallest_failures, with_measures,
)
from tests.llm.fixtures import awkward, documents, with_clashes

WHITE = set(" \t\n\x0b\x0c\r")


def split(text):
    return "".join(" " if c in WHITE else c for c in text).split(" ")


def brute(text):
    text = text or ""
    words = [w for w in split(text) if w]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(w for w in split(line)):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_measures(spark):
    rows = awkward()
    got = with_measures(documents(spark, rows)).select("doc_id", *MEASURES).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], *brute(r[1])) for r in rows], key=str)
    for text in ("a a a a", "a b c a b c", "a b c d", "a\n\na\nb\n a", "w " * 500):
        assert measure(text.encode())[:5] == brute(text)


def test_exact_binomial():
    assert binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert binomial_tail(2, 5, 0.5) == pytest.approx(0.5)
    assert binomial_tail(5, 5, 0.5) == 1.0
    k = smallest_failures(2000, 0.0125, 0.001)
    assert binomial_tail(k, 2000, 0.0125) <= 0.001 < binomial_tail(k + 1, 2000, 0.0125)
    assert smallest_failures(10, 0.0125, 0.001) == -1


def labelled(spark, n=6000):
    """Good documents of plain words, bad ones full of marks."""
    i = F.col("id")
    good = i % 5 != 0
    ks = F.sequence(F.lit(1), F.lit(70))
    mark = F.when(~good, F.lit("###")).otherwise(F.lit(""))
    text = F.array_join(F.transform(ks, lambda k: F.concat(F.lit("w"), ((i * 31 + k * k * 7 + k) % 997).cast("string"), mark)), " ")
    docs = spark.range(n).select(i.alias("doc_id"), text.alias("text"), F.when(i % 2 == 0, "en").alias("lang"))
    return docs, docs.select("doc_id", F.when(F.col("doc_id") % 5 != 0, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))


def test_certified_rules_reject_junk_and_keep_good_documents(spark):
    docs, labels = labelled(spark)
    out = judge(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    found = {(r.quality, r.kept): r["count"] for r in out}
    assert found == {(1, True): 4800, (0, False): 1200}


def test_nothing_is_certified_without_enough_labels(spark):
    docs, labels = labelled(spark, 200)
    out = judge(docs, labels)
    assert out.where("kept = base_failed").count() == 0
    assert judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_a_rare_stratum_is_judged(spark):
    """Some 110 good holdout documents carry a certificate; those of the frequent stratum do not speak for them."""
    docs, labels = labelled(spark)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 200, "rare").otherwise("en"))
    out = judge(docs, labels).join(labels, "doc_id").where("lang = 'rare'").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept): r["count"] for r in out} == {(1, True): 160, (0, False): 40}


def plain_cutoffs(rows, risk, delta):
    """Certification in plain Python: (stratum, holdout, values) of good documents to cutoffs per stratum."""
    strata = {s for s, held, _ in rows if not held} & {s for s, held, _ in rows if held}
    out = {}
    for s in strata:
        fit, held = ([v for t, h, v in rows if t == s and h == part] for part in (False, True))
        n, cuts = len(held), [math.inf] * len(RULES)
        for q in (1.0, 0.999, 0.995):
            for i in range(len(RULES)):
                tried = list(cuts)
                tried[i] = sorted(v[i] for v in fit)[math.ceil(q * len(fit)) - 1]
                bad = sum(any(x > c for x, c in zip(v, tried, strict=True)) for v in held)
                tail = sum(math.comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(bad + 1))
                if tail > delta / len(strata):
                    break
                cuts = tried
            else:
                continue
            break
        out[s] = [None if math.isinf(c) else c for c in cuts]
    return out


def test_certification_equals_a_plain_version(spark):
    rng = random.Random(5)
    rows = []
    for stratum, n, tail in (("a", 900, 0.0), ("b", 260, 0.3), (None, 60, 0.0), ("d", 500, 0.0)):
        for _ in range(n):
            held = rng.random() < 0.7
            spread = 3.0 if held and stratum == "d" else 1.0
            rows.append((stratum, held, [round(rng.random() ** 3 * spread * (1 + tail * i), 4) for i in range(len(RULES))]))
    data = spark.createDataFrame([(s, h, True, *v) for s, h, v in rows], f"s string, _holdout boolean, good boolean, {', '.join(f'{r} double' for r in RULES)}")
    got = {r["_stratum"]: [r[f"cut_{x}"] for x in RULES] for r in certified_cutoffs(data, "s", 0.05, 0.05, QUANTILES).collect()}
    want = plain_cutoffs(rows, 0.05, 0.05)
    assert got == want and None not in want["a"] and want[None] == [None] * len(RULES)


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = judge(docs, labels)
    rows = out.collect()
    assert len(rows) == len(awkward()) and set(docs.columns) <= set(out.columns)
    for r in rows:
        n, _, _, _, again = brute(r.text)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and r.kept == (not r.base_failed)
    assert judge(documents(spark, []), labels).count() == 0
