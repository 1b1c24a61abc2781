"""Primer pairs: interval self-join of hits, amplicons, and expected sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .kmers import LONG, far_pieces


def roles(n: int, all_orientations: bool = False) -> list[tuple[int, int, int]]:
    """pair, left and right pattern id for n primers (pair p is 2p - 1 and 2p; id + n is the reverse complement)."""
    out = []
    for pair in range(1, n // 2 + 1):
        a, b = 2 * pair - 1, 2 * pair
        ra, rb = a + n, b + n
        out += [(pair, a, b), (pair, rb, ra)]
        if all_orientations:
            out += [(pair, a, rb), (pair, b, a), (pair, b, ra), (pair, rb, a), (pair, ra, b), (pair, ra, rb)]
    return sorted(set(out))


def amplicons(hits: DataFrame, orientations: DataFrame, shortest: int, longest: int) -> DataFrame:
    """entry_id, pair_id, left_id, right_id, start_pos, end_pos, length, edits of both sides.

    A right hit pairs with a left one in its entry if the stretch from the left's start to the right's end has an allowed length.
    Both sides carry a bin of ``longest`` letters, so the range join is an equi-join on (entry, pair, bin) with two bins a left hit.
    """
    width = max(longest, 1)
    left = hits.join(orientations, hits["pattern_id"] == orientations["left_id"]).select("entry_id", "pair_id", "left_id", "right_id", "start_pos", F.col("end_pos").alias("left_end"), F.col("edits").alias("left_edits"))
    own = F.floor(F.col("start_pos") / width)
    left = left.withColumn("bin", F.explode(F.array(own, own + 1)))
    right = hits.select("entry_id", F.col("pattern_id").alias("right_id"), "end_pos", F.col("start_pos").alias("right_start"), F.col("edits").alias("right_edits"), F.floor(F.col("end_pos") / width).alias("bin"))
    length = F.col("end_pos") - F.col("start_pos")
    found = left.join(right, ["entry_id", "right_id", "bin"]).where(length.between(shortest, longest) & (F.col("right_start") >= F.col("start_pos")))
    return found.select("entry_id", "pair_id", "left_id", "right_id", "start_pos", "end_pos", length.alias("length"), "left_end", "right_start", "left_edits", "right_edits")


def with_sequence(found: DataFrame, sequences: DataFrame, between: bool = False) -> DataFrame:
    """The amplicon's letters and how many are N; between: only what stands between the primers."""
    start, end = ("left_end", "right_start") if between else ("start_pos", "end_pos")
    places = found.withColumn("start", F.col(start)).withColumn("length_", F.greatest(F.col(end) - F.col(start), F.lit(0)))
    longest = places.agg(F.coalesce(F.max("length_"), F.lit(0))).first()[0]
    held = places.withColumn("far", (F.floor(F.col("start") / LONG) * LONG).cast("bigint")).join(far_pieces(sequences, longest), ["entry_id", "far"], "left")
    out = held.withColumn("amplicon", F.coalesce(S.subsequence("part", F.col("start") - F.col("far"), "length_"), F.lit("")))
    return out.withColumn("n_count", S.n_count("amplicon")).drop("part", "far", "start", "length_")


def against_sizes(found: DataFrame, sts: DataFrame, tolerance: int) -> DataFrame:
    """Amplicons whose length deviates by at most the tolerance from the expected range. sts: pair_id, size_lb, size_ub."""
    return found.join(sts, "pair_id").withColumn("deviance", S.deviance("length", "size_lb", "size_ub")).where(F.col("deviance") <= tolerance)
