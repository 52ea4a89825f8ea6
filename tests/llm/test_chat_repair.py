"""Repair by block tables against a search over all edits, and the whole report against a plain version."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from demandspark.llm import chat_repair as op

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(symbols):
    """``(cost, audit)`` by trying every edit, up to three insertions in a row."""

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(10**9, "")]
        follow = "a" if state == "u" else "u"
        if i == len(symbols):
            ways += [(0, "")] if state in "-a" else []
        else:
            role, fault = symbols[i]
            options = [("D", 3, state)]
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                if role == follow or (role == "s" and state == "-"):
                    options.append(("K", extra, role))
                options.append(("R", 2 + extra, follow))
            for letter, cost, to in options:
                rest = best(i + 1, to, 0)
                ways.append((cost + rest[0], letter + rest[1]))
        if inserted < 3:
            rest = best(i, follow, inserted + 1)
            ways.append((2 + rest[0], "I" + rest[1]))
        return min(ways)

    return best(0, "-", 0)


def encoded(symbols):
    out = bytearray()
    for role, fault in symbols:
        out.append(0 if fault in ("blank", "duplicate") else 1 + 2 * ("sua".find(role) if role in "sua" else 3) + (fault == "truncated"))
    return bytes(out)


@pytest.mark.parametrize("seed", range(4))
def test_tables_find_the_smallest_cheapest_edits(seed):
    rng, repair = random.Random(seed), op.Tables()
    for _ in range(1500):
        symbols = tuple((rng.choice("suaxuaua"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 13)))
        cost, audit = cheapest(symbols)
        assert repair(encoded(symbols)) == (audit, cost), symbols


def test_block_length_changes_nothing(monkeypatch):
    rng = random.Random(9)
    rows = [bytes(rng.randrange(9) for _ in range(n)) for n in (1, 3, 5, 50, 501)]
    want = [op.Tables()(r) for r in rows]
    for length in (1, 2, 3):
        monkeypatch.setattr(op, "BLOCK", length)
        assert [op.Tables()(r) for r in rows] == want


def brute(rows, damage=True):
    hurt = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20 if damage else 9
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        hurt += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in hurt if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = cheapest(tuple((r[1][:1] or "-", f) for r, f in zip(mine, faults, strict=True)))
        state, left, lines = "-", iter(mine), []
        for letter in audit:
            follow = "a" if state == "u" else "u"
            if letter == "I":
                state = follow
                lines.append(("user" if state == "u" else "assistant") + ":")
                continue
            _, role, text = next(left)
            if letter == "K":
                state = role[:1]
            elif letter == "R":
                state, role = follow, "user" if follow == "u" else "assistant"
            if letter != "D":
                lines.append(f"{role}:{text}")
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def awkward(seed=2):
    rng = random.Random(seed)
    texts = ["Hello.", "hello", "Why?", "", None, " \n\t ", "end!\x0b", "ça va…", "日本。", "x" * 40_000, "a\nb", "No. \x0c", "nbsp\xa0"]
    roles = ["user", "assistant", "system", "User", "tool", "", None, "ü", "assist", "🙂"]
    rows = []
    for conv in [*range(60), None, -7, 2**60]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(roles) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2, 5 * turn]), role, rng.choice(texts)))
    rows += [(900, 1, "user", "again.")] * 50 + [(901, t, "user", "same.") for t in range(40)]
    rows += [(902, None, None, None)] * 3
    return rows


def got(df):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in columns) for r in rows}


def test_report(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = awkward()
    table = spark.createDataFrame(rows, TURNS).repartition(5)
    clashing = table.withColumns({c: F.lit("other") for c in ("k", "hit", "n", "first", "again", "digest", "kind", "audit", "pos", "earliest", "last")})
    assert got(op.repair_report(clashing, op.damaged(clashing))) == brute(rows)
    assert got(op.repair_report(clashing, clashing)) == brute(rows, damage=False)


def test_conversation_over_several_chunks(spark):
    """One conversation owns nearly all rows and spans ranges, chunks and blocks."""
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "tool"]), rng.choice(["Yes.", "no", f"t{t}."])) for t in range(700)]
    rows += [(1, 350, "user", "often.")] * 200 + [(c, 0, "user", "Hi.") for c in range(2, 9)]
    table = spark.createDataFrame(rows, TURNS).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = op.packed_rows(op.read_turns(table))
        assert op.packed_chunks(packed).where("conv_id = 1").select("part").distinct().count() > 1
        assert got(op.repair_report(table, table)) == brute(rows, damage=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_chunks_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op, "CHUNK", 4)
    batch = pa.RecordBatch.from_pydict({"conv_id": [1, 1, 2, None], "n": [1, 9, 1, 3], "first": [4, 5, 6, 7], "again": [2, 2, 2, 3]})
    found = [c for part in op.chunks([batch, batch.slice(3)]) for c in part]
    assert max(len(p) for _, p in found) == 4
    joined = {}
    for conv, p in found:
        joined[conv] = joined.get(conv, b"") + p
    assert joined == {1: bytes([4, 5, *[2] * 8]), 2: bytes([6]), None: bytes([7, 3, 3, 7, 3, 3])}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U"), (2, 0, "user", "")]
    turns = op.read_turns(spark.createDataFrame(rows, TURNS))
    out = op.repaired_turns(turns, op.diagnose(turns)).orderBy("conv_id", "pos").collect()
    assert [tuple(r) for r in out] == [(1, 0, "system", "S."), (1, 1, "user", ""), (1, 2, "assistant", "A.")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert op.repair_report(empty, op.damaged(empty)).collect() == []
