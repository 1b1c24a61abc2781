"""The prefix trie of conversations by preorder intervals.

A node is a sequence of turns with which some conversation begins. A turn's hash takes its role, its text and its depth; the
hash of a prefix is the xor of those of its turns, in two 64-bit halves, from a running total over all rows in order of conversation and depth.

1. Nodes are the groups of equal prefixes; each knows its parent's hash.
2. Leaves are ranked: the key of a leaf is the list of children taken at the branching nodes above it, ordered by hash at each of them.
   That is lexicographic order by hashes of turns. A path with b branching nodes has b other leaves as deep beside it, so of T turns in all no key has
   more than the square root of 2T entries.
3. A node's first and last leaf by rank give its place in preorder (by first leaf, then depth) and where its subtree ends.
4. Leaves and savings of a subtree are differences of running sums in preorder.

Rows of one conversation, members of one node and children of one parent may be any share of the table: running totals are taken part by part, groups
have partial sums, and joins are of written tables, so that Spark splits a frequent key. Only the SHA-256 of a node's members takes them one after
another, as it must: as a stream of joined ids of ``BLOCK`` members each, never gathered.

Turns are ordered by turn (null first), role and text; null roles and texts are empty. Rows without a conv_id take no part. Repeated rows are
repeated turns. An empty table gives no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scans import parts_of, running, sorted_parts
from .common import arrow_ddl, cut, release

#: Every conversation of so many in a row is rebuilt on the first of them; of at most so many of its first turns.
FAMILY, HEADS = 20, 4
WORDS = r"[^\x20\x09-\x0D]+"
#: Members joined in one row before a node's are hashed one after another.
BLOCK = 4096
_NODE = ["depth", "p1", "p2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), t1, t2 (hash of role and text), words. A written table."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.select("*", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "text", "role").alias("t2"), F.regexp_count("text", F.lit(WORDS)).cast("bigint").alias("words"), F.lit(1).cast("bigint").alias("place"))
    placed = running(made, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], ["conv_id", "t1", "t2", "words"], ("place",), key="conv_id")
    return placed.withColumnRenamed("place_to", "place")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, t1, t2, words: each conversation c with the first h turns of conversation c - c % family in place of its own first h, h = crc32(c) % heads; and all conv_ids."""
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = turns.where(F.col("place") < heads).groupBy("conv_id").agg(F.collect_list(F.struct("place", "t1", "t2", "words")).alias("head")).withColumnRenamed("conv_id", "base")
    known = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(first, "base", "left")
    known = known.select("conv_id", "h", F.coalesce(F.filter("head", lambda x: x["place"] <= F.col("h")), F.array().cast("array<struct<place:bigint,t1:bigint,t2:bigint,words:bigint>>")).alias("head"))
    taken = known.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.place").alias("depth"), "x.t1", "x.t2", "x.words")
    own = turns.where(F.col("place") > h).join(known.select("conv_id", (F.size("head") - F.col("h")).alias("shift")), "conv_id")
    return taken.unionByName(own.select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "t1", "t2", "words")), ids


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (hash of the prefix that ends here), q1, q2 (of the one before), words."""
    hashed = rows.select("conv_id", "depth", "words", F.xxhash64("depth", "t1", "t2").alias("g1"), F.xxhash64("t2", "depth", "t1").alias("g2"))
    found = running(hashed, ["conv_id", "depth"], ["conv_id", "depth", "words", "g1", "g2"], xors=("g1", "g2"), key="conv_id")
    return found.select("conv_id", "depth", F.col("g1_to").alias("p1"), F.col("g2_to").alias("p2"), F.col("g1_to").bitwiseXOR(F.col("g1")).alias("q1"), F.col("g2_to").bitwiseXOR(F.col("g2")).alias("q2"), "words")


def member_digests(ends: DataFrame) -> DataFrame:
    """depth, p1, p2, sha: of the ids (ascending, decimal, comma-joined) of the conversations that end at a node. ends: depth, p1, p2, conv_id."""
    blocks = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for *at, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (at != node or len(ids) == BLOCK):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = at
                ids.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), blocks.types, strict=True)], schema=blocks)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, ids[0], ",".join(map(str, ids))), blocks.types, strict=True)], schema=blocks)

    out_schema = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("sha", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = at, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), out_schema.types, strict=True)], schema=out_schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, state.hexdigest()), out_schema.types, strict=True)], schema=out_schema)

    joined = sorted_parts(ends.select(*_NODE, "conv_id"), [*_NODE, "conv_id"]).mapInArrow(join, arrow_ddl(blocks))
    return joined.repartition(parts_of(ends), *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digest, arrow_ddl(out_schema))


def leaf_ranks(rows: DataFrame, leaves: DataFrame, taken: DataFrame) -> DataFrame:
    """conv_id, rank (from 1) of each leaf in lexicographic order. rows: the prefixes of the leaves' conversations; taken: nodes whose parent has several children."""
    steps = rows.join(taken, _NODE, "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*_NODE))).alias("path"))
    keyed = leaves.select("conv_id").join(steps, "conv_id", "left").select("conv_id", F.coalesce("path", F.array().cast("array<struct<depth:bigint,p1:bigint,p2:bigint>>")).alias("path"), F.lit(1).cast("bigint").alias("rank"))
    return running(keyed, ["path"], ["conv_id"], ("rank",)).withColumnRenamed("rank_to", "rank")


def trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, pos and end_pos (its place in preorder, and its subtree's last)."""
    spark = conversations.sparkSession
    turns = turns_of(conversations)
    rows, ids = rebuilt(turns) if rebuild else (turns.withColumnRenamed("place", "depth"), turns.select("conv_id").distinct())
    ids, paths = cut(ids), prefixes(rows)
    whole = ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    ends = paths.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("end"))
    nothing = F.lit(0).cast("bigint")
    ends = ids.join(ends, "conv_id", "left").select("conv_id", *(F.coalesce(f"end.{c}", nothing).alias(c) for c in _NODE))
    digests = cut(member_digests(ends))

    bare = cut(paths.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2")))
    children = bare.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = cut(bare.join(children, _NODE, "left").fillna(0, ["n_children"]))
    release(bare)
    n_first = nodes.where("depth = 1").count()
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("branch"))
    top = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(whole.least).cast("bigint")).withColumn("branch", F.lit(n_first > 1))
    known = cut(nodes.where("depth > 1").join(above, ["depth", "q1", "q2"]).unionByName(top))
    release(nodes)

    leaves = known.where("n_children = 0")
    own = cut(paths.select("conv_id", *_NODE).join(leaves.select("conv_id"), "conv_id", "left_semi"))
    ranks = leaf_ranks(own, leaves, known.where("branch").select(*_NODE))
    spans = own.join(ranks, "conv_id").groupBy(*_NODE).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    laid = known.join(spans, _NODE).select("*", F.lit(1).cast("bigint").alias("pos"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    keep = [*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "first", "last", "saved", "leaf"]
    placed = running(laid, ["first", "depth"], keep, ("pos", "saved", "leaf"))
    release(own, known)
    stops = placed.where("leaf = 1").select("last", F.col("pos_to").alias("end_pos"), F.col("saved_to").alias("saved_end"), F.col("leaf_to").alias("leaf_end"))
    inner = placed.join(stops, "last").select(
        *_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("leaf_end") - F.col("leaf_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"), F.col("pos_to").alias("pos"), "end_pos",
    )
    totals = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("saved"), nothing).alias("saved"), F.coalesce(F.sum("leaf"), nothing).alias("leaves")).first()
    root = [(0, 0, 0, whole.least, None, whole.n, n_first, max(totals.leaves, 1), totals.saved, 0, totals.n)] if whole.n else []
    every = inner.unionByName(spark.createDataFrame(root, inner.schema))
    empty = sha256(b"").hexdigest()
    out = every.join(digests, _NODE, "left").select("*", F.coalesce("sha", F.lit(empty)).alias("ends_sha256"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "pos", "end_pos")
