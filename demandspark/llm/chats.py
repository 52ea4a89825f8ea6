"""Chat formatting with cumulative-snapshot collapse.

Chat logs often store a conversation again after every turn. Each turn gets a hash of its position, role and text, and
the running XOR of these hashes names every prefix of a conversation. A logged conversation whose last hash is a proper
prefix hash of another one is a snapshot of it; anti-joins on the hashes leave the maximal conversations, which are then
rendered. Positions are part of each hash, so that XOR, which can be summed in any order, still fixes the sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import read_table
from demandspark.session import materialise


def distinct_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, n_turns, role, text)``: turns in order, each logged turn once, numbered from 1.

    Order is by turn, then role, then text (nulls first), so turns with the same number have a defined order. Rows
    without ``conv_id`` belong to no conversation and are left out. A conversation is read as a sorted stream.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    row = F.struct("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    fresh = rows.withColumn("_again", row.eqNullSafe(F.lag(row).over(order))).where(~F.col("_again"))
    numbered = fresh.withColumn("pos", F.row_number().over(order))
    return numbered.withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id"))).drop("_again")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, n_turns, h1, h2)``: the 120-bit rolling hash of the turns up to ``pos``."""
    digest = F.sha2(F.to_json(F.struct("pos", "role", "text")), 256)
    upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    halves = {f"h{k + 1}": F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(2)}
    hashed = turns.select("conv_id", "pos", "n_turns", *[h.alias(n) for n, h in halves.items()])
    return hashed.select("conv_id", "pos", "n_turns", *[F.bit_xor(h).over(upto).alias(h) for h in halves])


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of conversations that are no proper prefix of another one; of equal ones the
    smallest id stands for all ``n_copies``."""
    hashes = materialise(prefix_hashes(distinct_turns(conversations)), "prefixes")
    key = ["pos", "h1", "h2"]
    # Equal conversations and equal openings are reduced to one row before they meet, however many there are.
    whole = hashes.where(F.col("pos") == F.col("n_turns")).groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")
    )
    inner = hashes.where(F.col("pos") < F.col("n_turns")).select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def format_chats(
    conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", unknown: str = "unknown"
) -> DataFrame:
    """``(conv_id, n_turns, n_copies, rendered)``, one row per maximal conversation.

    A turn is rendered as ``start role newline text end newline``. Null roles read ``unknown``, null texts are empty.
    Where a role or text holds one of the two markers, a space is put behind its ``<``, so that no text can open or end
    a turn. Columns other than conv_id, turn, role and text are ignored. An empty table gives an empty result.
    """

    def tame(c):
        for marker in (start, end):
            c = F.replace(c, F.lit(marker), F.lit(marker[:1] + " " + marker[1:]))
        return c

    best = materialise(maximal_conversations(conversations), "maximal")
    role, text = F.coalesce("role", F.lit(unknown)), F.coalesce("text", F.lit(""))
    piece = F.concat(F.lit(start), tame(role), F.lit("\n"), tame(text), F.lit(end), F.lit("\n"))
    turns = conversations.join(best.select("conv_id"), "conv_id", "left_semi")
    pieces = distinct_turns(turns).select("conv_id", F.struct("pos", piece.alias("piece")).alias("turn"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    rendered = whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("rendered"))
    return best.join(rendered, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


def _tame(c: str) -> str:
    for marker in ("<|im_start|>", "<|im_end|>"):
        c = f"replace({c}, '{marker}', '{marker[:1]} {marker[1:]}')"
    return c


OP5_SQL = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
    text NULLS FIRST) AS pos FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(to_json({{'r': role, 't': text}})::VARCHAR, chr(10)) OVER (PARTITION BY conv_id ORDER BY pos) AS s FROM t),
w AS (SELECT s, min(conv_id) AS conv_id, any_value(n) AS n, count(*) AS c FROM p WHERE pos = n GROUP BY s),
m AS (SELECT * FROM w WHERE s NOT IN (SELECT s FROM p WHERE pos < n))
SELECT m.conv_id, any_value(m.n)::BIGINT AS n_turns, any_value(m.c)::BIGINT AS n_copies,
    string_agg('<|im_start|>' || {_tame("coalesce(role, 'unknown')")} || chr(10) || {_tame("coalesce(text, '')")}
        || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM m JOIN t USING (conv_id) GROUP BY m.conv_id
"""
