import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import demandspark.llm.ngram_join as nj
from demandspark.llm.common import components
from tests.llm.fixtures import awkward, documents, with_clashes


def gram_set(text, n):
    words = [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    """Components over all pairs, for rows of different ids."""
    sets = {r[0]: gram_set(r[1], n) for r in rows if r[0] is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return sorted(((r[0], len(gram_set(r[1], n)), None if r[0] is None else root(r[0])) for r in rows), key=str)


def mutated(seed, n_base=12, copies=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows, i = [], 0
    for b in range(n_base):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 12, 40, 150, 400]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
            if rng.random() < 0.3:
                text += "\n" + passage
            if rng.random() < 0.2:
                text = text.upper()
            rows.append((i, text, None, f"s{b}", None))
            i += 1
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_equals_all_pairs(spark, n, percent, seed):
    rows = mutated(seed)
    got = nj.near_duplicates(documents(spark, rows), n, percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, n, percent)


def test_small_blocks_and_batches(spark, monkeypatch):
    rows = mutated(3, n_base=2, copies=40)
    docs = documents(spark, rows)
    monkeypatch.setattr(nj, "BLOCK_WEIGHT", nj.DOC_WEIGHT * 3)
    monkeypatch.setattr(nj, "SAMPLE", 1)
    monkeypatch.setattr(nj, "BATCH_TOKENS", 300)
    got = nj.near_duplicates(docs, 3, 80, broadcast_bytes=-1)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 80)


def test_awkward_rows(spark):
    rows = awkward()
    got = nj.near_duplicates(with_clashes(documents(spark, rows)), 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 90)
    assert nj.near_duplicates(documents(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = mutated(4) + [(500, "same row again here now", "a", "b", 1)] * 3 + [(501, "SAME row again here now", "a", "b", 1)]
    rows += [(None, "x", None, None, None), (502, None, None, None, None), (503, "", None, None, None)]
    kept = nj.drop_near_duplicates(documents(spark, rows))
    found = brute(rows, 5, 80)
    want = sorted({i for i, n, c in found if i is not None and (i == c or not n)})
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 1 and kept.columns == documents(spark, rows).columns


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 50)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    parent = {}
    for a, b in links:
        group = {a, b} | {x for x in parent if parent[x] in (parent.get(a, a), parent.get(b, b))}
        low = min([parent.get(x, x) for x in group])
        parent.update(dict.fromkeys(group, low))
    assert got == {n: r for n, r in parent.items() if any(n in x and x[0] != x[1] for x in links)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").where(F.lit(True)).count() == 0


def all_pairs(rows, n, percent):
    """Links of every row, by position, and the pairs of different sets by their smallest ids."""
    sets = [gram_set(r[1], n) if r[0] is not None else frozenset() for r in rows]
    first = {}
    for r, s in zip(rows, sets, strict=True):
        first[s] = min(first.get(s, r[0]), r[0]) if s else None
    links, pairs = [0] * len(rows), set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                if a != b:
                    pairs.add(tuple(sorted((first[a], first[b]))))
    return links, sorted(pairs)


def test_no_link_is_lost(spark, monkeypatch):
    rows = mutated(3, n_base=2, copies=40)
    rows += [(1000 + i, r[1], None, "copy", None) for i, r in enumerate(rows) if i % 7 == 0]
    rows += [(2000, "", None, None, None), (2001, None, None, None, None), (None, rows[0][1], None, None, None)]
    monkeypatch.setattr(nj, "BLOCK_WEIGHT", nj.DOC_WEIGHT * 30)
    docs = documents(spark, rows)
    links, pairs = all_pairs(rows, 3, 60)
    want = [(*x, links[i] if rows[i][0] is not None else None) for i, x in enumerate(by_position(rows, 3, 60))]
    assert sorted(map(tuple, nj.linked_documents(docs, 3, 60).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, nj.linked_pairs(docs, 3, 60).collect())) == pairs
    assert len(pairs) > 4 * len(rows)


def by_position(rows, n, percent):
    found = {x[0]: x for x in brute(rows, n, percent)}
    return [found[r[0]] for r in rows]


def test_the_query_counts_links(spark, tmp_path):
    rows = mutated(6, n_base=3, copies=12)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_links for r in nj.op7_ngram_join(spark, str(tmp_path)).collect()}
    assert got == {r[0]: k for r, k in zip(rows, all_pairs(rows, 3, 90)[0], strict=True)}


def test_rows_of_a_reused_id_are_documents_of_their_own(spark):
    long = [" ".join(f"w{k}_{i}" for i in range(60)) for k in range(5)]
    near = long[0] + " more"
    rows = [
        (7, long[0], "en", "a", 1), (7, long[1], "en", "a", 1),  # both clean
        (8, near, "en", "a", 1), (8, long[2], "en", "a", 1),  # one repeats document 7
        (9, long[3], "en", "a", 1), (9, long[3], "en", "a", 1),  # repeated row
        (5, long[4], "en", "a", 1), (6, long[4], "en", "a", 1), (10, "", "en", "a", 0), (10, None, "en", "a", 0), (None, long[4], "en", "a", 1),
    ]
    docs = documents(spark, rows).withColumn("_row", F.lit("other"))
    kept = nj.drop_near_duplicates(docs, n=5, percent=80)
    assert kept.columns == docs.columns and {r["_row"] for r in kept.collect()} == {"other"}
    want = [(7, long[0]), (7, long[1]), (8, long[2]), (9, long[3]), (5, long[4]), (10, ""), (10, None), (None, long[4])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("fragments", [1, 3, 16])
def test_fragments_of_the_order_sum_to_the_same_links(spark, monkeypatch, fragments):
    """Core, bounds and partial counts together give what whole sets do, however the order is cut."""
    monkeypatch.setattr(nj, "VERIFY_FRAGMENTS", fragments)
    monkeypatch.setattr(nj, "BLOCK_WEIGHT", nj.DOC_WEIGHT * 9)
    rows = mutated(8, n_base=2, copies=25)
    docs = documents(spark, rows)
    links, pairs = all_pairs(rows, 3, 70)
    assert {r.doc_id: r.n_links for r in nj.linked_documents(docs, 3, 70).collect()} == {r[0]: k for r, k in zip(rows, links, strict=True)}
    assert sorted(map(tuple, nj.linked_pairs(docs, 3, 70).collect())) == pairs


def test_a_task_counts_its_own_fragment_only():
    rng = random.Random(2)
    sets = [np.unique(np.array(rng.sample(range(60), rng.randint(25, 45)), np.uint64)) for _ in range(12)]
    sizes = np.array([len(x) for x in sets], np.int64)
    block = nj.Block(np.arange(12), np.ones(12, np.int64), sizes, sizes, sizes)
    cut = [[x[(x >= lo) & (x < lo + 20)] for x in sets] for lo in (0, 20, 40)]
    parts = [nj.fragment_counts(block, block, c, c, True, 40) for c in cut]
    match = nj.matched(block, block, parts, True, 40)
    for a in range(12):
        for b in range(12):
            common = len(np.intersect1d(sets[a], sets[b]))
            assert match[a, b] == (a != b and 100 * common >= 40 * (sizes[a] + sizes[b] - common))
    assert any(p.any() for p in parts) and not np.array_equal(match, nj.matched(block, block, parts[:1], True, 40))


def test_clashing_names_and_no_rows_where_links_are_counted(spark):
    rows = awkward()
    got = nj.linked_documents(with_clashes(documents(spark, rows)), 3, 90).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows, 3, 90)
    links = all_pairs(rows, 3, 90)[0]
    want = [(r[0], k if r[0] is not None else None) for r, k in zip(rows, links, strict=True)]
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == sorted(want, key=str)
    assert nj.linked_documents(documents(spark, [])).count() == 0
