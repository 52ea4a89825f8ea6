"""Conversation structure repair with Four-Russians block tables.

Every row of a conversation becomes one symbol: what its role's initial allows and what its fault demands. The cheapest
edits towards the role pattern ``(s?(ua)+)?`` follow from cost vectors over the pattern's four states: what the rows from
here on cost, seen from each state. Less their first entry these vectors take few values, so that one table holds, for
every block of ``BLOCK`` symbols and every vector behind it, the vector before it. Blocks are passed by lookup from the
end to the start, and only their border vectors are kept. Tracing then runs from the start: each block is expanded
backward from its right border, and in each state the cheapest edit with the smallest letter is taken. Since every
remaining cost is exact, the letters taken are the smallest string of all cheapest ones. Expanded blocks are remembered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import batch_of, column, read_table
from demandspark.session import materialise

#: Symbols in a block.
BLOCK = 4
#: Symbols that one packed row holds.
CHUNK = 1 << 16
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that may follow, whether rerolled or inserted.
NEXT = (USER, USER, ASSISTANT, USER)
#: States in which a conversation may end.
ENDS = (START, ASSISTANT)
#: Symbol 0 must be deleted; 1 + 2 * role + truncated otherwise, role by its place in this string, 3 for others.
ROLES = "sua"
SYMBOLS = 9
#: The state after keeping a row, by role and state; -1 where the pattern does not allow it.
KEPT = ((SYSTEM, -1, -1, -1), (USER, USER, -1, USER), (-1, -1, ASSISTANT, -1), (-1,) * 4)
NAMES = {USER: "user", ASSISTANT: "assistant"}

Vector = tuple[int, ...]


def closed(costs: list[float]) -> Vector:
    """With turns inserted before what follows: at most two of them lead to any state that insertion can reach."""
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT + out[NEXT[q]]) for q, c in enumerate(out)]
    return tuple(int(c) for c in out)


END = closed([0 if q in ENDS else float("inf") for q in range(4)])


def choices(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """What may become of a row: letter, cost, state behind it, by ascending letter."""
    yield "D", DELETE, state
    if symbol:
        role, cut_off = divmod(symbol - 1, 2)
        if KEPT[role][state] >= 0:
            yield "K", KEEP + CUT_OFF * cut_off, KEPT[role][state]
        yield "R", REROLE + CUT_OFF * cut_off, NEXT[state]


def before(symbol: int, behind: Vector) -> Vector:
    return closed([min(cost + behind[to] for _, cost, to in choices(symbol, q)) for q in range(4)])


class Tables:
    """Normalised vectors and, for blocks of each length up to ``BLOCK``, what stands before them."""

    def __init__(self):
        self.vectors: list[Vector] = [tuple(c - END[0] for c in END)]
        number = {self.vectors[0]: 0}
        vector, added = [], []
        for v in self.vectors:  # grows until no symbol leads to a new one
            row = [before(s, v) for s in range(SYMBOLS)]
            normal = [tuple(c - w[0] for c in w) for w in row]
            for n in normal:
                if n not in number:
                    number[n] = len(self.vectors)
                    self.vectors.append(n)
            vector.append([number[n] for n in normal])
            added.append([w[0] for w in row])
        one, extra = np.array(vector).T, np.array(added).T  # by symbol and vector
        to, cost = one, extra
        self.to, self.cost = [None, one.tolist()], [None, extra.tolist()]
        for _ in range(BLOCK - 1):
            # A further symbol in front of every block: its step starts from the vector before the block.
            to, cost = one[:, to], cost[None] + extra[:, to]
            to, cost = to.reshape(-1, len(self.vectors)), cost.reshape(-1, len(self.vectors))
            self.to.append(to.tolist())
            self.cost.append(cost.tolist())
        self.known: dict[tuple[bytes, int, int], tuple[str, int]] = {}

    def borders(self, symbols: bytes) -> tuple[list[int], int]:
        """The vector behind every block, last block first, and the cost of the whole from the start."""
        v, total, out = 0, END[0], []
        for at in range((len(symbols) - 1) // BLOCK * BLOCK, -1, -BLOCK) if symbols else ():
            out.append(v)
            block = symbols[at : at + BLOCK]
            code = 0
            for s in block:
                code = code * SYMBOLS + s
            total += self.cost[len(block)][code][v]
            v = self.to[len(block)][code][v]
        return out, total

    def trace(self, block: bytes, behind: int, state: int) -> tuple[str, int]:
        """The letters of a block from a state on, and the state behind it."""
        key = (block, behind, state)
        found = self.known.get(key)
        if found is not None:
            return found
        costs = [self.vectors[behind]]
        for s in reversed(block):
            costs.append(before(s, costs[-1]))
        costs.reverse()
        letters = ""
        for k, symbol in enumerate(block):
            edit = ""
            while edit in ("", "I"):
                here = costs[k][state]
                ways = [(e, to) for e, cost, to in choices(symbol, state) if cost + costs[k + 1][to] == here]
                if INSERT + costs[k][NEXT[state]] == here:
                    ways.append(("I", NEXT[state]))
                edit, state = min(ways)
                letters += edit
        self.known[key] = letters, state
        return letters, state

    def __call__(self, symbols: bytes) -> tuple[str, int]:
        """``(audit, cost)`` of the rows that the symbols stand for."""
        borders, cost = self.borders(symbols)
        state, pieces = START, []
        for at in range(0, len(symbols), BLOCK):
            letters, state = self.trace(symbols[at : at + BLOCK], borders.pop(), state)
            pieces.append(letters)
        while state not in ENDS:
            pieces.append("I")
            state = NEXT[state]
        return "".join(pieces), cost


@lru_cache(maxsize=1)
def tables() -> Tables:
    """One set per Python worker, kept between its tasks."""
    return Tables()


def apply_edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns that the edits make of the rows, which are taken one by one."""
    state = START
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield NAMES[state], ""
            continue
        role, text = next(rows)
        if edit == "R":
            state = NEXT[state]
            yield NAMES[state], text
        elif edit == "K":
            state = KEPT[ROLES.index(role[0])][state]
            yield role, text


SPACES = " \t\n\x0b\x0c\r"
CLEAN, TRUNCATED, DUPLICATE, BLANK = range(4)
#: A packed row is 4 * role + fault; what that means as a symbol.
SYMBOL_OF = bytes(0 if fault >= DUPLICATE else 1 + 2 * role + fault for role in range(4) for fault in range(4))
#: Role pairs that may follow each other, as 4 * left + right.
ALTERNATING = [4 * ROLES.index(x) + ROLES.index(y) for x, y in ("su", "ua", "au")]
ORDER = ("conv_id", "turn", "role", "digest")


def read_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``; null roles and texts read as one space."""
    space = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the damage that a checksum of each row's key picks: of twenty parts one is dropped, one loses its
    text, one its sentence ends, one is repeated, one takes the user's role. Null numbers read as one space in the key."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = read_turns(conversations).withColumn("hit", F.pmod(F.crc32(key.cast("binary")), F.lit(20))).where("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("k")).drop("k")


def digest() -> Column:
    return F.unhex(F.md5("text"))


def packed_rows(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, n, first, again)``: equal rows once, with their number; ``first`` is the packed
    byte of the first of them, ``again`` that of the others.

    A row repeats an earlier one if an earlier turn holds the same role and text. Everything is an aggregate, so a
    conversation that owns most rows, or one text that is most of a conversation, is reduced before it moves.
    """
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    narrow = turns.select("conv_id", "turn", "role", digest().alias("digest"), last.alias("last"))
    once = narrow.groupBy(*ORDER).agg(F.count("*").alias("n"), F.first("last").alias("last"))
    once = materialise(once, "turns")
    # A struct, so that the null turn is the smallest.
    turn = F.struct("turn")
    several = once.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(turn).alias("earliest"), F.count("*").alias("k")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    rows = once.join(several.where("k > 1"), same, "left")
    repeated = F.col("earliest").isNotNull() & (turn != F.col("earliest"))
    fault = F.when(F.col("last") == "", BLANK).when(repeated, DUPLICATE).when(F.col("last").isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)
    role = F.substring("role", 1, 1)
    role = sum((F.when(role == r, k - len(ROLES)).otherwise(0) for k, r in enumerate(ROLES)), F.lit(len(ROLES)))
    again = F.when(F.col("last") == "", BLANK).otherwise(DUPLICATE)
    return rows.select(*ORDER, "n", (4 * role + fault).cast("int").alias("first"), (4 * role + again).cast("int").alias("again"))


def packed_chunks(rows: DataFrame) -> DataFrame:
    """``(conv_id, part, seq, packed)``: up to ``CHUNK`` consecutive rows of a conversation, one byte each.

    The rows are dealt by ranges of their order, so that no task sorts a conversation longer than a range.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in chunks(batches):
            numbers = range(seq, seq + len(batch))
            seq += len(batch)
            yield batch_of(schema, [c for c, _ in batch], [part] * len(batch), numbers, [p for _, p in batch])

    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    narrow = dealt.select(F.col("conv_id").cast("long").alias("conv_id"), "n", "first", "again")
    return narrow.mapInArrow(run, "conv_id long, part int, seq long, packed binary")


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes]]]:
    """Chunks of a sorted stream in lists of bounded size."""
    out: list[tuple[int | None, bytes]] = []
    held, conv, size = bytearray(), None, 0
    for batch in batches:
        fields = (column(batch, n).to_pylist() for n in ("conv_id", "n", "first", "again"))
        for of, n, first, again in zip(*fields, strict=True):
            if held and of != conv:
                out.append((conv, bytes(held)))
                held.clear()
            conv = of
            for code, left in ((first, 1), (again, n - 1)):
                while left:
                    take = min(left, CHUNK - len(held))
                    held.extend(bytes([code]) * take)
                    left -= take
                    if len(held) == CHUNK:
                        out.append((conv, bytes(held)))
                        held.clear()
                    if (size := size + take) >= 16 * CHUNK:
                        yield out
                        out, size = [], 0
    if held:
        out.append((conv, bytes(held)))
    if out:
        yield out


def diagnose(turns: DataFrame) -> DataFrame:
    """``(conv_id, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation with rows.

    Meets a conversation's packed rows in one task: one byte a row, as many as the audit string itself has letters.
    """
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = tables()
        parts = (r for b in batches for r in zip(column(b, "conv_id").to_pylist(), column(b, "packed").to_pylist(), strict=True))
        out, size = [], 0
        for conv, group in groupby(parts, lambda r: r[0]):
            packed = b"".join(p for _, p in group)
            codes = np.frombuffer(packed, np.uint8)
            faults = np.bincount(codes & 3, minlength=4).tolist()
            pairs = (codes[:-1] & 12) + (codes[1:] >> 2)
            audit, cost = repair(packed.translate(SYMBOL_OF.ljust(256, b"\0")))
            out.append((conv, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], int((~np.isin(pairs, ALTERNATING)).sum()), cost, audit))
            if (size := size + len(audit) + 100) >= 16 * CHUNK:
                yield batch_of(schema, *zip(*out, strict=True))
                out, size = [], 0
        yield batch_of(schema, *(list(zip(*out, strict=True)) or [[]] * 7))

    dealt = packed_chunks(packed_rows(turns)).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return dealt.mapInArrow(run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, pos, role, text)``: the turns that the edits of ``audits`` leave, numbered from 0.

    The audit leads its conversation's rows in one sorted stream, which is read row by row; partitions hold whole
    conversations in order. An empty repaired conversation has no row.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(column(b, n).to_pylist() for n in ("conv_id", "role", "text")), strict=True))
        out, size = [], 0
        for conv, group in groupby(rows, lambda r: r[0]):
            _, _, audit = next(group)
            for pos, (role, text) in enumerate(apply_edits(audit, ((r, t) for _, r, t in group))):
                out.append((conv, pos, role, text))
                if (size := size + len(text) + 50) >= 1 << 22:
                    yield batch_of(schema, *zip(*out, strict=True))
                    out, size = [], 0
        yield batch_of(schema, *(list(zip(*out, strict=True)) or [[]] * 4))

    conv = F.col("conv_id").cast("long").alias("conv_id")
    lead = audits.select(conv, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"))
    rest = turns.select(conv, F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", digest().alias("digest"), "text")
    dealt = lead.union(rest).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, pos long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of what ``repaired_turns`` returns, in its order: ``role:text`` lines, hashed as
    they come."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(column(b, n).to_pylist() for n in ("conv_id", "role", "text")), strict=True))
        out = []
        for conv, group in groupby(rows, lambda r: r[0]):
            sha, between = hashlib.sha256(), ""
            for _, role, text in group:
                sha.update(f"{between}{role}:{text}".encode())
                between = "\n"
            out.append((conv, sha.hexdigest()))
            if len(out) >= 4096:
                yield batch_of(schema, *zip(*out, strict=True))
                out = []
        yield batch_of(schema, *(list(zip(*out, strict=True)) or [[]] * 2))

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: ``gaps`` in the turn numbers, numbers of rows by first fault
    (``blank``, ``duplicate``, ``truncated``), ``illegal`` neighbours, ``cost`` and ``audit`` of the cheapest repair of
    ``turns``, and ``repaired_sha256`` of its result.

    Rows without ``conv_id`` are one conversation. Rows of a conversation are ordered by turn (nulls first), then role,
    then digest of the text; repeated rows stand together and all but the first are duplicates. Roles count by their
    initial, an empty role has none. A conversation without rows in ``turns`` has zeros, an empty audit and the hash of
    nothing. Other columns are ignored, whatever their names; empty tables give an empty result. A conversation's audit
    holds a letter for each row and its hash is one sequence, so both are made in one task, which streams the texts and
    holds a byte per row; audits are bounded by Spark's 2 GB a value.
    """
    turns = read_turns(turns)
    audits = materialise(diagnose(turns), "audits")
    span = turns.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps")
    )
    hashes = digests(repaired_turns(turns, audits))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for k, found in enumerate((span, audits, hashes)):
        found = found.withColumnRenamed("conv_id", f"_{k}")
        out = out.join(found, F.col("conv_id").eqNullSafe(F.col(f"_{k}")), "left").drop(f"_{k}")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )


def op12_chat_repair(spark, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


OP12_SQL = r"""
WITH RECURSIVE crc_in AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS r,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT * EXCLUDE (k), xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS h FROM crc_in),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, r,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS again FROM hit WHERE h <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again, r) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS x FROM dam),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(bare, 1) IN ('.', '!', '?') THEN 'c' ELSE 't' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM num),
c AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
opt AS (SELECT conv_id, i, x, fault = 't' AS tr, fault IN ('b', 'd') AS gone FROM f),
-- cheapest (cost, letters) of the rows from i on, for each state: nothing yet, after system, user, assistant
raw(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, n + 1, {'c': 0, 't': ''}, {'c': 4, 't': 'II'}, {'c': 2, 't': 'I'}, {'c': 0, 't': ''} FROM c
  UNION ALL
  SELECT conv_id, i, least(e0, {'c': u1.c + 2, 't': 'I' || u1.t}), least(s0, {'c': u1.c + 2, 't': 'I' || u1.t}), u1,
    least(a0, {'c': u0.c + 2, 't': 'I' || u0.t}) FROM (
  SELECT *, least(u0, {'c': a0.c + 2, 't': 'I' || a0.t}) AS u1 FROM (
  SELECT o.conv_id, o.i,
    least({'c': e.c + 3, 't': 'D' || e.t}, CASE WHEN gone OR x NOT IN ('s', 'u') THEN NULL WHEN x = 's' THEN {'c': s.c + tr::INT, 't': 'K' || s.t}
      ELSE {'c': u.c + tr::INT, 't': 'K' || u.t} END, CASE WHEN NOT gone THEN {'c': u.c + 2 + tr::INT, 't': 'R' || u.t} END) AS e0,
    least({'c': s.c + 3, 't': 'D' || s.t}, CASE WHEN NOT gone AND x = 'u' THEN {'c': u.c + tr::INT, 't': 'K' || u.t} END,
      CASE WHEN NOT gone THEN {'c': u.c + 2 + tr::INT, 't': 'R' || u.t} END) AS s0,
    least({'c': u.c + 3, 't': 'D' || u.t}, CASE WHEN NOT gone AND x = 'a' THEN {'c': a.c + tr::INT, 't': 'K' || a.t} END,
      CASE WHEN NOT gone THEN {'c': a.c + 2 + tr::INT, 't': 'R' || a.t} END) AS u0,
    least({'c': a.c + 3, 't': 'D' || a.t}, CASE WHEN NOT gone AND x = 'u' THEN {'c': u.c + tr::INT, 't': 'K' || u.t} END,
      CASE WHEN NOT gone THEN {'c': u.c + 2 + tr::INT, 't': 'R' || u.t} END) AS a0
  FROM raw JOIN opt o ON o.conv_id IS NOT DISTINCT FROM raw.conv_id AND o.i = raw.i - 1))),
best AS (SELECT conv_id, e.c::BIGINT AS cost, e.t AS audit FROM raw WHERE i = 1),
letters AS (SELECT conv_id, p, audit[p] AS l, count(*) FILTER (audit[p] <> 'I') OVER w AS i, count(*) FILTER (audit[p] <> 'D') OVER w AS pos
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best) WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
first AS (SELECT l.conv_id, coalesce(bool_or(l.l = 'K' AND f.x = 's'), false) AS sys
  FROM letters l JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i GROUP BY l.conv_id),
lines AS (SELECT l.conv_id, p, CASE WHEN l.l = 'K' THEN f.role WHEN (pos - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN l.l = 'I' THEN '' ELSE f.text END AS line
  FROM letters l JOIN first s ON s.conv_id IS NOT DISTINCT FROM l.conv_id
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE l.l <> 'D'),
done AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
