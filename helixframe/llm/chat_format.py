"""Chat formatting: collapse logged snapshots of growing conversations and render what is left.

A chat service logs a conversation again after every turn, so most logged conversations are prefixes of longer ones.
Rolling hashes of turn prefixes make "is a prefix of" an equality: a conversation goes when its whole-conversation hash is
the hash of a proper prefix of any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import null_safe_hash, table

_LOW = 0xFFFFFFFF


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """One row per distinct turn: conv_id, n (turns so far), k (128-bit hash of these turns), last (ends the conversation).

    Turns are ordered by turn (null last); rows equal in conv_id, turn, role and text count once, other rows of one turn
    number follow each other in the order of their hashes. The hash is a running sum of position-salted turn hashes in four
    32-bit lanes, so a window computes it in one pass without holding the conversation.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        null_safe_hash(1, F.col("role"), F.col("text")).alias("h1"),
        null_safe_hash(2, F.col("role"), F.col("text")).alias("h2"),
    )
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "h1", "h2")
    salted = turns.distinct().select(
        "conv_id",
        "turn",
        "h1",
        "h2",
        F.row_number().over(w).alias("n"),
        F.lead("h1").over(w).isNull().alias("last"),
    ).select(
        "*",
        F.xxhash64(F.lit(3), "n", "h1", "h2").alias("p1"),
        F.xxhash64(F.lit(4), "n", "h2", "h1").alias("p2"),
    )
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lanes = [f(p) for p in ("p1", "p2") for f in (lambda p: F.col(p).bitwiseAND(F.lit(_LOW)), lambda p: F.shiftrightunsigned(p, 32))]
    return salted.select("conv_id", F.col("n").cast("long").alias("n"), "last", F.struct(*[F.sum(x).over(so_far).alias(f"s{i}") for i, x in enumerate(lanes)]).alias("k"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no prefix of another.

    Of equal conversations the one with the smallest conv_id stays. Rows without conv_id belong to no conversation and go.
    Equal conversations and equal prefixes are aggregated before the anti-join, so a very common first turn or a very common
    conversation is one row on either side.
    """
    hashes = prefix_hashes(conversations)
    whole = hashes.where("last").groupBy("n", "k").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashes.where(~F.col("last")).select("n", "k").distinct()
    return whole.join(inner, ["n", "k"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """Render every maximal conversation: conv_id, n_turns, n_copies, text.

    A null role is rendered as ``unknown``, a null text as an empty one. An empty table gives an empty result. Other columns
    are ignored.
    """
    kept = maximal_conversations(conversations)
    turns = conversations.select("conv_id", "turn", "role", "text").join(kept, "conv_id")
    entry = F.struct(
        F.col("turn").isNull().alias("no_turn"),
        "turn",
        null_safe_hash(1, F.col("role"), F.col("text")).alias("h1"),
        null_safe_hash(2, F.col("role"), F.col("text")).alias("h2"),
        F.concat(F.lit(opening), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(closing + "\n")).alias("line"),
    )
    return (
        turns.groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_set(entry)).alias("turns"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(F.col("turns.line"), "").alias("text"))
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, concat('<|im_start|>', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) AS line
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS n, string_agg(line, '') OVER (w ROWS UNBOUNDED PRECEDING) AS k,
         lead(1) OVER w IS NULL AS is_last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, line)),
whole AS (SELECT n, k, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE is_last GROUP BY n, k)
SELECT conv_id, n AS n_turns, n_copies, k AS text FROM whole
WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT is_last AND p.n = whole.n AND p.k = whole.k)
"""

QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {"op1_chat_format": ORACLE}
