import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandspark.llm import lines
from demandspark.llm.lines import Suspects, dedup_lines, found_in_segments, positions, repeat_filters
from tests.llm.fixtures import awkward, documents, with_clashes

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_docs, keep):
    texts = [(r[0], r[1] or "") for r in rows]
    counts = Counter(k for _, t in texts for k in {key(x) for x in t.split("\n")} if k)
    first = {}
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            first.setdefault(key(line), (i, t, n))
    out = []
    for i, t in texts:
        ls = t.split("\n")
        gone = [bool(key(x)) and counts[key(x)] >= min_docs and not (keep == "first" and first[key(x)] == (i, t, n)) for n, x in enumerate(ls)]
        out.append((i, len(ls), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(ls, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 1000, -1])
@pytest.mark.parametrize(("keep", "min_docs"), [("none", 10), ("none", 2), ("first", 2)])
def test_equals_brute_force(spark, keep, min_docs, broadcast_bytes):
    rows = [r for r in awkward() if r[0] is not None] if keep == "first" else awkward()
    got = dedup_lines(documents(spark, rows), min_docs, keep, segment_lines=50, broadcast_bytes=broadcast_bytes)
    assert result(got) == sorted(brute(rows, min_docs, keep), key=str)


def test_filters_too_large_to_send_still_decide(spark, monkeypatch):
    """Beyond the broadcast bound the segments look the hashes up: lines seen once never leave their documents, and with
    filters that hold nothing no line is dropped."""
    rows = [(i, f"shared by all\nonly here {i}\npair {i // 2}", "s", "en", 0) for i in range(60)]
    docs = documents(spark, rows)
    asked = found_in_segments(docs, repeat_filters(docs, 4, 1 << 14, 1 << 14, 1), 4, 1 << 14, 1, 3)
    found = {r.id: len(r.suspects) for r in asked.collect()}
    assert set(found) == set(range(60)) and sum(found.values()) <= 60 * 2 + 2
    far = dict(segment_lines=20, broadcast_bytes=-1, spread=3)
    assert {r.text for r in dedup_lines(docs, 10, "none", **far).collect()} == {f"only here {i}\npair {i // 2}" for i in range(60)}
    none = lambda *a: repeat_filters(*a).withColumn("bits", F.unhex(F.repeat(F.lit("00"), F.length("bits"))))
    monkeypatch.setattr(lines, "repeat_filters", none)
    assert {r.n_dropped for r in dedup_lines(docs, 2, "none", **far).collect()} == {0}


def test_columns_and_empty_table(spark):
    docs = with_clashes(documents(spark))
    out = dedup_lines(docs, 2)
    assert out.columns == [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert {r.key for r in out.collect()} == {"other"}
    assert dedup_lines(documents(spark, []), 2).count() == 0
    nothing = dedup_lines(documents(spark, [(1, None, None, None, None)]), 1).collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in nothing] == [(None, 1, 0)]


def test_short_keys_stay(spark):
    rows = [(i, "é\nlonger line", None, None, 0) for i in range(4)]
    assert {r.text for r in dedup_lines(documents(spark, rows), 2, "none", min_chars=2).collect()} == {"é"}


def test_filter_has_no_false_negatives():
    import numpy as np

    held = np.arange(1, 3000, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = {}
    for s in range(3):
        own = np.zeros(4096, bool)
        own[positions(held[held % np.uint64(3) == s] // np.uint64(3), 4096)] = True
        bits[s] = np.packbits(own, bitorder="little").tobytes()
    assert Suspects(bits, 3, 4096)(held).all()
    with pytest.raises(ValueError):
        dedup_lines(None, keep="last")
