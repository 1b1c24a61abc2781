"""Which side of a join is sent around, in the plans of the registered queries."""

import re

import pytest

from strandloom import catalog
from strandloom.functions import seq as S
from strandloom.operators import graph, match, programs
from strandloom.plans import lineage

SF = "/root/testdata/sf0.001"


def broadcast_over(df, node):
    """Whether a broadcast exchange of the plan that Spark begins with has such a node below it."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n") + df._jdf.queryExecution().executedPlan().toString().split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = re.search(r"\w", line).start()
            for below in lines[i + 1 :]:
                if not re.search(r"\w", below) or re.search(r"\w", below).start() <= depth:
                    break
                if node in below and "[entry_id" in below:
                    return True
    return False


PATTERN_JOINS = "q1_primer_match_counts q1_primer_match q1_counts_by_edits_and_strand q1_constrained_lines a2_strand_aggregate r2_count_lines r6_tandem_lines q6_peptide_scan j1_exact_match j6_mismatches j7_edit_ends j10_seeded_mismatches j12_spaced_seeds w7_tandem_repeats a16_inexact_counts".split()


@pytest.mark.parametrize("name", PATTERN_JOINS)
def test_no_broadcast_of_exploded_sequences(spark, name):
    assert not broadcast_over(catalog.QUERIES[name](spark, SF), "Generate")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("buckets", [1 << 20, 8])
def test_many_patterns_are_merged(spark, monkeypatch, buckets):
    """The same hits whether pattern words are broadcast, thinned out and merged, or merged alone."""
    dna, patterns = catalog.dna(spark, SF), catalog.patterns(spark, SF)
    plans = {
        "exact": lambda: match.exact(dna, patterns.unionByName(patterns.selectExpr("pattern_id + 100 as pattern_id", "left(pattern, 4) as pattern"))),
        "mismatches": lambda: match.mismatches(dna, patterns, 2),
        "edits": lambda: match.edit_ends(dna, patterns, 1),
        "spaced": lambda: programs.spaced_mismatches(dna, patterns, 1, programs.covering(6, 1, 4)),
    }
    want = {k: rows(f()) for k, f in plans.items()}
    monkeypatch.setattr(match, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(match, "BUCKETS", buckets)
    monkeypatch.setattr(match, "FILTER_WORDS", 0)
    for k, f in plans.items():
        df = f()
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert not broadcast_over(df, "Generate")
        assert rows(df) == want[k] and want[k]


def test_word_expressions(spark):
    words = ["ACGT", "ACGA", "TT", "TTA", "A.", "GG\\C", "(x"]
    texts = ["", "ACG", "ACGTT", "xACGA", "A.", "AB", "GG\\C", "GGC", "(x", "x", "T", "aTT"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t for r in df.where(df.t.rlike(S.any_of(words))).collect()} == {t for t in texts if any(w in t for w in words)}


def test_numbered_graphs_list_words_once(spark):
    """What reads a numbered graph many times reads a written table, not the words of the texts again."""
    texts = spark.createDataFrame([(1, "ACGTTGCAACGTACGTTGCA"), (2, "TTGCAACGGACGTTGAC")], "entry_id long, seq string")
    edges = graph.numbered_graph(graph.text_graph(texts, 3))
    assert edges.count() and "Generate" not in edges._jdf.queryExecution().executedPlan().toString()


def test_points_are_dealt_by_their_number(spark, monkeypatch):
    """A task's points don't grow with the table, and what is made of an entry's points exchanges them no more."""
    monkeypatch.setattr(lineage, "TASK_ROWS", 1000)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for name, of in (("t1_union", 2 * n), ("t2_intersection", 2 * n), ("w2_islands", n)):
        df = catalog.QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and df.rdd.getNumPartitions() == -(-of // 1000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    own = {(r.l_suppkey, r.l_partkey) for r in lines}
    shifted = {(a + 1, b) for a, b in own}
    for name, want in (("t1_union", own | shifted), ("t2_intersection", own & shifted)):
        got = catalog.QUERIES[name](spark, SF).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
