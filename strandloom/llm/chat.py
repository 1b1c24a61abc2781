"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once after every turn. The turns of a
conversation, by turn, role and text, get rolling hashes: the hash of a prefix is the
xor of the hashes of its turns, each taken with its place, in two independent
64-bit halves. A conversation whose whole hash is the hash of a longer one's prefix of
the same length is a snapshot; an anti-join drops those, of equal ones the
smallest conv_id stays, and the maximal ones are rendered.

Null roles and texts count as empty strings; rows with a null conv_id are one conversation.
Repeated rows are repeated turns. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, h1, h2 (hash of the prefix that ends here)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("place", F.row_number().over(order))
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "conv_id",
        "place",
        "role",
        "text",
        F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "text", "role", "place")).over(so_far).alias("h2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_snapshots (equal conversations collapsed into it, itself included) of the conversations to keep."""
    prefixes = prefix_hashes(turns)
    last = Window.partitionBy("conv_id")
    marked = prefixes.select("conv_id", "place", "h1", "h2", F.max("place").over(last).alias("n_turns"))
    whole = marked.where("place = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"))
    inner = marked.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_snapshots")


def render(turns: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, n_snapshots, chat of every maximal conversation."""
    rows = turns.select(F.col("conv_id").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = maximal(turns)
    said = F.concat(F.lit(begin), "role", F.lit("\n"), "text", F.lit(end), F.lit("\n"))
    chats = rows.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text", said.alias("said")))).alias("all"))
    return kept.join(chats, kept["conv_id"].eqNullSafe(chats["c"])).select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "n_snapshots", F.array_join(F.transform("all", lambda x: x["said"]), "").alias("chat"))
