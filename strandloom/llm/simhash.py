"""SimHash near-duplicates by multi-index hashing.

Fingerprint: words (maximal runs of bytes outside 0x20 and 0x09-0x0D, A-Z
lower-cased), shingles of ``SHINGLE`` words with repeats, XXH64 with seed 42; a bit is set
if it is set in over half of the hashes. Fewer words than a shingle: the whole
sequence is the one shingle. No word, null or empty text: fingerprint zero, linked like any other.

Links: equal fingerprints are one node, so a group of copies costs one row.
The 64 bits are cut into three segments. Two fingerprints that differ in ``RADIUS`` = 4
bits or fewer differ in at most one bit of some segment, so every fingerprint
probes the tables with the Hamming ball of radius one around each of its
segments (67 keys), and full distances of what it meets are checked inside the
join. Only links leave the join. Components: alternating large-star and
small-star rounds on the links, each cut off by a written table.

Empty table: empty result. Ties cannot occur (the smallest doc_id wins); rows that repeat a
doc_id are nodes of their own texts under that id and come back as often as they went in. Rows without a doc_id
link like any other; a group of only such rows has no component_id.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, release

SHINGLE, RADIUS, SEED = 4, 4, 42
#: (lowest bit, width) of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Beyond so many distinct fingerprints the tables of shorter segments are so full that two segments with balls of radius two meet fewer.
DENSE = 40_000_000
WIDE = ((0, 32), (32, 32))
#: A byte's bits, highest first, spread over the eight bytes of an integer: sums of up to 255 rows count bits without carries.
_SPREAD = np.array([sum(((b >> (7 - i)) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype="<u8")


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter((b" ".join(words),)), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))), len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=">u8", count=n)
    spread = np.zeros((-(-n // 255) * 255, 8), dtype="<u8")
    spread[:n] = _SPREAD[hashes.view(np.uint8).reshape(n, 8)]
    counts = spread.reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


_OUT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed integer)."""

    def make():
        return lambda doc_id, text: (doc_id, (v := fingerprint(text)) - (v >> 63 << 64))

    return map_rows(docs, ["doc_id", "text"], _OUT, make)


def scheme(n: int) -> tuple[tuple, int]:
    """Segments and radius of the balls for n distinct fingerprints. Both find every pair up to a distance of 5; they differ in keys probed (67 or 1058) and rows met."""
    return (SEGMENTS, 1) if n <= DENSE else (WIDE, 2)


def _segment(fp, at: int, width: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a < b of distinct fingerprints' nodes within the radius. nodes: fp (distinct), node (never null)."""
    segments, ball = scheme(nodes.count())
    if radius >= (ball + 1) * len(segments):
        raise ValueError(f"{len(segments)} segments with balls of radius {ball} are complete up to a distance of {(ball + 1) * len(segments) - 1}")
    tables = nodes.select(
        F.col("fp").alias("fp_a"),
        F.col("node").alias("a"),
        F.explode(F.array(*(F.struct(F.lit(i).alias("s"), _segment(F.col("fp"), at, w).alias("k")) for i, (at, w) in enumerate(segments)))).alias("x"),
    ).select("fp_a", "a", "x.s", "x.k")

    def keys(i: int, at: int, width: int):
        flips = F.split(F.lit(",".join(str(sum(1 << x for x in c)) for n in range(ball + 1) for c in combinations(range(width), n))), ",").cast("array<bigint>")
        return F.transform(flips, lambda flip: F.struct(F.lit(i).alias("s"), _segment(F.col("fp"), at, width).bitwiseXOR(flip).alias("k")))

    balls = F.flatten(F.array(*(keys(i, at, w) for i, (at, w) in enumerate(segments))))
    probes = nodes.select(F.col("fp").alias("fp_b"), F.col("node").alias("b"), F.explode(balls).alias("x")).select("fp_b", "b", "x.s", "x.k")
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius
    # Spark takes the exploded sides to be as large as the nodes, 67 times too small, and would send them through the driver.
    return tables.join(probes.hint("merge"), ["s", "k"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link. edges: a, b."""
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u")
        large = large.distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("x")).select("x.v", "x.u").where("v != u")
        before, edges = edges, cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % (1 << 40))).first()
        release(before)
        if now == seen:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included)."""
    marked = cut(fingerprints(docs))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    reached = components(links(nodes.select("fp", F.col("fp").alias("node")), radius)).withColumnRenamed("node", "fp")
    linked = cut(nodes.join(reached, "fp"))
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(least, "component").select("fp", "least")
    groups = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of every group, columns unchanged; rows without an id stay."""
    others = near_duplicates(docs.where("doc_id is not null"), radius).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)
