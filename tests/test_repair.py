"""Graph repairs and tracks against worked examples and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import graph, kmers, repair
from strandloom.plans import formats

EDGES = "src string, dst string, label string, n bigint"


def reads_of(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs, 1)), "entry_id bigint, seq string")


def graph_of(reads, m):
    return kmers.count(kmers.words(reads, m + 1)).select(F.expr(f"left(kmer, {m})").alias("src"), F.expr(f"right(kmer, {m})").alias("dst"), F.expr("right(kmer, 1)").alias("label"), "n")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_node_is_split_by_reads(spark):
    reads = reads_of(spark, "AAACGTTT", "GGACGCCC")
    edges = graph_of(reads, 3)
    got = rows(repair.resolved_by_reads(edges, reads))
    want = {tuple(r) for r in edges.collect()} - {("GAC", "ACG", "G", 1), ("ACG", "CGC", "C", 1)}
    assert got == sorted(want | {("GAC", "ACG#GAC,G", "G", 1), ("ACG#GAC,G", "CGC", "C", 1)})
    assert repair.widgets(spark.createDataFrame(got, EDGES)).count() == 0


def test_an_edge_is_split_by_reads(spark):
    reads = reads_of(spark, "AAACGTCCG", "GGACGTTTA")
    got = rows(repair.resolved_by_reads(graph_of(reads, 3), reads))
    copy = {("GAC", "ACG#GAC,G", "G", 1), ("ACG#GAC,G", "CGT#GAC,G", "T", 1), ("CGT#GAC,G", "GTT", "T", 1)}
    assert copy <= set(got)
    assert not {("GAC", "ACG"), ("CGT", "GTT")} & {r[:2] for r in got}
    assert {("AAC", "ACG"), ("ACG", "CGT"), ("CGT", "GTC")} <= {r[:2] for r in got}


def test_unconfirmed_ways_change_nothing(spark):
    reads = reads_of(spark, "AAACGTTT", "GGACG", "ACGCCC")
    edges = graph_of(reads, 3)
    assert rows(repair.resolved_by_reads(edges, reads)) == rows(edges)
    assert repair.resolved_by_reads(edges.where("false"), reads).count() == 0


def test_every_read_is_still_a_walk(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(8)]
    reads = reads_of(spark, *seqs)
    edges = graph_of(reads, 4)
    got = repair.resolved_by_reads(edges, reads).collect()
    plain = {(r.src.split("#")[0], r.dst.split("#")[0]) for r in got}
    assert plain == {(s[i : i + 4], s[i + 1 : i + 5]) for s in seqs for i in range(len(s) - 4)}
    assert len(got) == len({(r.src, r.dst, r.label) for r in got})


def test_components_are_chained_in_order(spark):
    pair = lambda a, b: (a, b, "x", 1)
    open_ones = [pair("a1", "a2"), pair("b1", "b2"), pair("c1", "c2")]
    cycle = [pair("d1", "d2"), pair("d2", "d1")]
    got = rows(repair.joined_components(spark.createDataFrame(open_ones + cycle, EDGES)))
    assert got == [("a2", "b1", "$b1"), ("b2", "c1", "$c1")]
    assert rows(repair.joined_components(spark.createDataFrame(cycle, EDGES))) == []


def test_terminators_are_cut_out(spark):
    edges = spark.createDataFrame([("ACG", "TTA", "T$CTTA", 2), ("$CG", "CGT", "T", 1), ("ACG", "CGT", "T", 5), ("AC$", "C$G", "G", 1)], EDGES)
    assert rows(repair.without_terminators(edges, 3)) == [("ACG", "CGT", "T", 7), ("CTT", "TTA", "A", 2)]


def test_tracks(spark):
    counts = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 4, 4, 5, 9, 9, 1, 4])], "entry_id bigint, pos int, n bigint")
    got = repair.path_tracks(counts, 3, "log2")
    assert rows(got) == [(1, 4, 7, 3), (1, 7, 9, 4), (1, 10, 11, 3)]
    assert rows(repair.path_tracks(counts, 3, "unique", every=True)) == [(1, 3, 4, 1), (1, 4, 9, 2), (1, 9, 10, 1), (1, 10, 11, 2)]
    lines = got.withColumn("name", F.lit("e")).select(formats.wig_bar(), repair.value_letter(F.col("value"))).orderBy("start")
    assert tuple(lines.first()) == ("e 4 7 3", "d")
    assert formats.wig_header(4).endswith("name=4-mer-cnt priority=10 graphType=bar autoScale=off viewLimits=1:20")


@pytest.mark.parametrize(("transform", "every"), [("log2", False), ("unique", True), ("count", True)])
def test_tracks_of_texts_sort_no_places(spark, monkeypatch, transform, every):
    """The tracks of the counted places, found piece by piece: with borders in stretches, other letters, words that no edge has, short and absent texts."""
    monkeypatch.setattr(kmers, "LONG", 16)
    monkeypatch.setattr(kmers, "_LETTERS", 100)
    rnd = random.Random(5)
    texts = {i: "".join(rnd.choice("ACGT") for _ in range(n)) for i, n in enumerate([0, 3, 4, 19, 20, 35, 90])} | {10: "A" * 50 + "NN" + "A" * 31, 11: None, 12: "ACGTN" * 20}
    own = spark.createDataFrame(list(texts.items()), "entry_id long, seq string")
    edges = spark.createDataFrame([("AAA", "A", 9), ("ACG", "TTA", 3), ("TAC", "G", 1), ("GTT", "A", 2), ("CCC", "CCC", 4)], "src string, label string, n long")
    got = repair.text_tracks(own, edges, 3, transform, every)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    want = rows(repair.path_tracks(graph.path_counts(own, edges, 3), 3, transform, every))
    assert rows(got) == want and len(want) > 5
