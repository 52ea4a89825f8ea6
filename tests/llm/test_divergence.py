"""The audit against a plain version with exact integers, and the sparse merge against sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from demandspark.llm import divergence as op
from tests.llm.fixtures import awkward, documents, with_clashes


def brute(rows, min_docs, top):
    pattern = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = pattern.findall(lowered)
        groups.add((lang, source))
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        mine = [s for la, s in groups if la == lang]
        whole = Counter()
        for s in mine:
            whole.update(counts[lang, s])

        def share(c, kept=kept):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (size + 5 * len(kept)) for t in kept}

        p, q = share(counts[lang, source]), share(whole)
        others = {s: share(counts[lang, s]) for s in mine if s != source}
        pairs = [(-sum(abs(p[t] - o[t]) for t in kept), s.encode(), s) for s, o in others.items()]
        terms = [(q[t] - p[t], t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, last in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:last])]
    return sorted(out)


def many(seed, n=400, sources=40):
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "Lo", "mü", "日", "z") for b in ("", "ra", "TI", "é")] + ["x1y", "A@B", "o'k", "[q]", "\x7fdel\x00nul"]
    rows = []
    for i in range(n):
        source = f"s{rng.randrange(sources)}" if rng.random() < 0.6 else "hot"
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, ""]), source, 1))
    return [*rows, (1000, "", "only", "one", 0), (1001, None, "bare", "a", 0), (1002, "rare words", "bare", None, 0)]


@pytest.mark.parametrize("min_docs, top", [(1, 3), (5, 50), (10**6, 5)])
def test_audit(spark, min_docs, top):
    rows = awkward()
    got = op.audit(with_clashes(documents(spark, rows)).drop("name"), min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, min_docs, top)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_and_chunks(spark, monkeypatch, seed):
    """More groups than a block, more terms than a chunk, and hand-overs in the middle of a task."""
    monkeypatch.setattr(op, "BLOCK_GROUPS", 3)
    monkeypatch.setattr(op, "CHUNK_TERMS", 4)
    monkeypatch.setattr(op, "GATHERED", 50)
    monkeypatch.setattr(op, "WINDOW", 40)
    rows = many(seed)
    assert sorted(map(tuple, op.audit(documents(spark, rows), 6, 7).collect())) == brute(rows, 6, 7)


def test_empty_table(spark):
    assert op.audit(documents(spark, [])).collect() == []


def test_overlap_gallops():
    rng = random.Random(8)
    for n, m in [(0, 0), (0, 9), (3, 5000), (5000, 4), (2000, 3000), (1, 1)]:
        a, b = (np.array(sorted(rng.sample(range(8000), k)), np.int64) for k in (n, m))
        i, j = op.overlap(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_shares_are_exact_for_large_counts():
    counts = [0, 1, 10**12, 9 * 10**14]
    size, vocabulary = 10**15, 10**6
    want = [1 + 10**9 * (c + 5) // (size + 5 * vocabulary) for c in counts]
    assert op.shares(np.array(counts), size, vocabulary).tolist() == want


def test_share_column_is_exact(spark):
    counts = [0, 1, 10**12, 9 * 10**14]
    table = spark.createDataFrame([(c, 10**15, 10**6) for c in counts], "n long, size long, vocabulary long")
    got = [r[0] for r in table.orderBy("n").select(op.share("n", "size")).collect()]
    assert got == [1 + 10**9 * (c + 5) // (10**15 + 5 * 10**6) for c in counts]


def test_terms_are_not_cut(monkeypatch):
    monkeypatch.setattr(op, "WINDOW", 5)
    text = "Abcdefgh ij, KLMNOPQRSTüé x" * 3
    assert [t for part in op.terms_in(text.encode()) for t in part] == op.TERM.findall(text.encode().lower())
