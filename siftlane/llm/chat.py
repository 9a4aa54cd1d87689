"""Operator 9, chat formatting with cumulative-snapshot collapse.

Logs hold the same conversation again and again, each time with more turns. The rolling hash of a prefix is
the exclusive or of one 128-bit hash for each (position, role, text), so that one window gives every prefix's
hash. A conversation whose whole hash is a proper prefix's hash of another one goes (anti-join); of equal ones
the smallest conv_id stays. What is left is rendered, a marked block for each turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.common import materialize


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns without repeats, numbered, each with hash and length of the prefix that it ends."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    last = F.lag(F.struct("turn", "role", "text")).over(order)
    rows = rows.withColumn("last", last).where(~F.coalesce(F.col("last").eqNullSafe(F.struct("turn", "role", "text")), F.lit(False)))
    rows = rows.withColumn("pos", F.row_number().over(order))
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "conv_id",
        "pos",
        role.alias("role"),
        text.alias("text"),
        F.bit_xor(F.xxhash64("pos", role, text)).over(upto).alias("h1"),
        F.bit_xor(F.xxhash64(text, F.lit(0x5BD1E995), role, "pos")).over(upto).alias("h2"),
        F.lead("pos").over(order).isNull().alias("whole"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another one."""
    prefixes = materialize(_turns(conversations).select("conv_id", "pos", "h1", "h2", "whole"), "prefixes")
    whole = prefixes.where("whole").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = prefixes.where("not whole").select("pos", "h1", "h2")
    return whole.join(longer, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered of each conversation that is no prefix of another one.

    Turns are in the order of (turn, role, text), null first; rows that repeat are one turn, and turns that share a
    number all count. A null role is 'unknown', a null text empty. Rows with a null conv_id are one conversation. Of
    equal conversations the smallest conv_id stays (null only if no other is there). '<|' in a text is rendered as
    '< |', so that no text can make a mark. Other columns are ignored. An empty table gives none.
    """
    kept = materialize(maximal(conversations), "maximal").select(F.col("conv_id").alias("kept"), "n_turns")
    block = F.concat(F.lit("<|start|>"), "role", F.lit("\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    turns = _turns(conversations).select("conv_id", "pos", block.alias("block"))
    rendered = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda t: t["block"]), "").alias("rendered"))
    return rendered.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).select("conv_id", "n_turns", "rendered")


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations
), c AS (
  SELECT conv_id, list({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id
), m AS (
  SELECT min(conv_id) AS conv_id, turns FROM c a
  WHERE NOT EXISTS (SELECT 1 FROM c b WHERE len(b.turns) > len(a.turns) AND b.turns[1:len(a.turns)] = a.turns)
  GROUP BY turns
)
SELECT conv_id, len(turns)::BIGINT AS n_turns,
  array_to_string(list_transform(turns, lambda x: '<|start|>' || x.role || chr(10) || replace(x.text, '<|', '< |') || '<|end|>' || chr(10)), '') AS rendered
FROM m
"""
