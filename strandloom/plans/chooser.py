"""Which plan finds a set of patterns: an application-level choice from pattern statistics, as in the table of the README."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import match


@dataclass(frozen=True)
class Statistics:
    n: int
    shortest: int
    mean: float
    ambiguous: int


def statistics(patterns: DataFrame) -> Statistics:
    """One row of aggregates over the pattern table."""
    r = patterns.agg(F.count("*").alias("n"), F.min(F.length("pattern")).alias("s"), F.avg(F.length("pattern")).alias("m"), F.count_if(F.col("pattern").rlike("[^ACGT]")).alias("a")).first()
    return Statistics(r.n, r.s or 0, float(r.m or 0), r.a)


def choose(stats: Statistics, k: int = 0, indels: bool = True, wildcards: bool = False, left: int = 0, right: int = 0, word: int | None = None) -> str:
    """exact, scan, anchored, words, pieces or edits."""
    if k and k >= stats.shortest - max(left, right) > 0 or k and k >= stats.shortest:
        raise ValueError("as many errors as inexact letters: every place would match")
    if k == 0:
        return "scan" if wildcards and stats.ambiguous else "exact"
    if indels:
        return "edits"
    return "words" if word else "anchored" if max(left, right) >= 6 else "pieces"


def find(sequences: DataFrame, patterns: DataFrame, k: int = 0, indels: bool = True, wildcards: bool = False, text_n: bool = False, left: int = 0, right: int = 0, word: int | None = None) -> DataFrame:
    """Hits by the chosen plan. With indels: a hit a cluster of ends (first_end, last_end, with pattern and text as an alignment needs them); else one a place."""
    plan = choose(statistics(patterns), k, indels, wildcards, left, right, word)
    if plan == "exact":
        return match.exact(sequences, patterns)
    if plan == "scan":
        return match.scan(sequences, [tuple(r) for r in patterns.select("pattern_id", "pattern").collect()], True, text_n)
    if plan == "edits":
        return match.clusters(match.edit_ends(sequences, patterns, k, word, with_text=True), k)
    return match.mismatches(sequences, patterns, k, word, left, right)
