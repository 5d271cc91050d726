"""Whole conversations rendered in order, in pieces of bounded size.

A conversation may have any number of turns, so it is never gathered in one
group.  Messages are range-partitioned by ``(conv_id, turn, message)``, which
spreads even one very long conversation over many tasks.  The characters before
each message are a running sum inside its partition plus the totals of the same
conversation in the partitions before (one row per partition and conversation,
so that table stays small).  A message whose start lies in
``[p * piece_chars, (p + 1) * piece_chars)`` belongs to piece ``p``; a piece
is assembled by one ordered aggregation and holds at most ``piece_chars``
characters plus one message.

Cases: a message with a null role or text renders as the empty string.  Null
``conv_id`` rows form one conversation of their own; null turns come first, and
``first_turn`` is the smallest turn that is not null.
Messages of equal turn follow in the order of their rendered text, so repeated
rows are all kept.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.chat import render_message
from glyphloom.session import stage

#: characters of rendered messages after which a new piece starts
PIECE_CHARS = 1 << 16


def render_conversations(turns: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``conv_id, piece, first_turn, n_turns, chat`` from ``conv_id, turn, role, text``."""
    message = F.coalesce(render_message(F.col("role"), F.col("text")), F.lit(""))
    ranged = stage(turns.select("conv_id", "turn", message.alias("message"))
                   .repartitionByRange("conv_id", "turn", "message")
                   .withColumn("_part", F.spark_partition_id())
                   .withColumn("_len", F.length("message").cast("long")))
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part", "conv_id").orderBy("turn", "message").rowsBetween(*earlier)
    local = ranged.withColumn("_before", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
    totals = ranged.groupBy("_part", "conv_id").agg(F.sum("_len").alias("_total"))
    across = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(*earlier)
    offsets = totals.select(F.col("_part").alias("_p"), F.col("conv_id").alias("_c"),
                            F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    placed = local.join(offsets, (F.col("_part") == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_c")))
    piece = F.expr(f"(_offset + _before) div {int(piece_chars)}")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "message")))
    return placed.select("conv_id", "turn", "message", piece.alias("piece")).groupBy("conv_id", "piece").agg(
        F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(ordered, lambda m: m["message"]), "").alias("chat"))


def oracle(piece_chars: int = PIECE_CHARS) -> str:
    """DuckDB SQL for ``render_conversations`` over ``conversations``."""
    return f"""
WITH m AS (
  SELECT conv_id, turn, coalesce('[[' || role || ']]' || chr(10) || text || chr(10), '') AS message
  FROM conversations),
s AS (
  SELECT *, coalesce(sum(length(message)) OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, message
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM m)
SELECT conv_id, CAST(start // {int(piece_chars)} AS BIGINT) AS piece, min(turn) AS first_turn,
  count(*) AS n_turns, string_agg(message, '' ORDER BY turn NULLS FIRST, message) AS chat
FROM s GROUP BY conv_id, start // {int(piece_chars)}
"""
