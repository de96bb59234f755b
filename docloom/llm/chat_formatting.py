"""Chat formatting with collapse of cumulative snapshots, with DataFrame functions only.

Logs often hold a conversation again after every turn. The rolling hash of a turn prefix is the xor of
hashes of (position, role, text); a conversation whose whole hash is a proper prefix hash of another one is
a snapshot of it and goes by an anti-join, equal conversations keep the smallest id. What is maximal is
rendered, each turn between ``<|im_start|>`` and ``<|im_end|>`` marks.

Turns are shuffled once, by conversation; what is matched are hashes, and what is kept joins the turns where they lie.

Hot groups: common prefixes are made distinct and equal conversations are counted before the anti-join, both
with map-side combination. A conversation is a unit: its turns meet in one task, as its rendering needs.

Defined cases: null role or text counts as empty; turns that repeat a number stand in the order of role and
text; rows without a conversation id are one conversation of id null; marks inside a text are split by a
blank so that they end no turn; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH = ["h1", "h2", "n"]


def with_prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, role, text, h1, h2, n): each turn with the rolling hash of the ``n`` turns up to it; ``conv`` is a struct, which equals itself also where the id is null."""
    rows = turns.select(F.struct(F.col(conv).alias("id")).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = rows.withColumn("n", F.row_number().over(order)).withColumn("n_turns", F.count(F.lit(1)).over(Window.partitionBy("conv")))
    upto = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("h1", F.bit_xor(F.xxhash64("n", "role", "text")).over(upto)).withColumn("h2", F.bit_xor(F.xxhash64(F.lit("turn"), "text", "n", "role")).over(upto))


def maximal_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv, n_copies): conversations that are no prefix of another, the smallest id of equal ones."""
    hashed = with_prefix_hashes(turns, **columns)
    whole = hashed.where("n = n_turns").groupBy(*HASH).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = hashed.where("n < n_turns").select(*HASH).distinct()
    return whole.join(prefixes, HASH, "left_anti").select("conv", "n_copies")


def format_chats(turns: DataFrame, **columns: str) -> DataFrame:
    """(id, n_turns, n_copies, chat) of the maximal conversations."""
    kept = maximal_conversations(turns, **columns)
    safe = F.replace("text", F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|im_start|>"), F.replace("role", F.lit("<|"), F.lit("< |")), F.lit("\n"), safe, F.lit("<|im_end|>\n"))
    rows = with_prefix_hashes(turns, **columns).select("conv", "n", line.alias("line"))
    chats = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    chat = F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat")
    return chats.join(kept, "conv").select("conv.id", F.size("lines").cast("bigint").alias("n_turns"), "n_copies", chat)


def op7_chat_formatting(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat of the maximal conversations of ``conversations``."""
    return format_chats(conversations).select(F.col("id").alias("conv_id"), "n_turns", "n_copies", "chat")


OP7_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                  count(*) OVER (PARTITION BY conv_id) AS n
           FROM conversations),
p AS (SELECT *, string_agg(sha256(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t),
w AS (SELECT upto, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE i = n GROUP BY upto),
k AS (SELECT conv_id, n_copies FROM w WHERE upto NOT IN (SELECT upto FROM p WHERE i < n))
SELECT t.conv_id, count(*) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY i) AS chat
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY t.conv_id
"""
