"""Steps over all words of large tables: results by brute force, and plans that list or exchange no more than they must."""

import random
from collections import defaultdict

import pytest

from strandloom import catalog
from strandloom.operators import graph, kmers, uniq

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, texts, names="entry_id long, seq string"):
    return spark.createDataFrame(list(enumerate(texts, 1)), names)


def spelt_graph(texts, m):
    """Edges between neighbouring branching words, as the definition has them."""
    around = defaultdict(list)
    for e, t in enumerate(texts):
        for i in range(len(t) - m + 1):
            around[t[i : i + m]].append((t[i - 1] if i else (e, "l"), t[i + m] if i + m < len(t) else (e, "r")))
    split = lambda side: len(set(side)) > 1 or any(isinstance(x, tuple) for x in side)
    chosen = {w for w, sides in around.items() if len(sides) > 1 and (split([a for a, _ in sides]) or split([b for _, b in sides]))}
    out = {}
    for e, t in enumerate(texts, 1):
        at = [i for i in range(len(t) - m + 1) if t[i : i + m] in chosen]
        for i, j in zip(at, at[1:]):
            key = (t[i : i + m], t[j : j + m], t[i + m : j + m])
            n, first = out.get(key, (0, (e, i)))
            out[key] = n + 1, min(first, (e, i))
    return out


@pytest.mark.parametrize("m", [2, 5, 7])
def test_word_graph_of_texts(spark, m, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 8)  # labels of several blocks
    draw = random.Random(m)
    texts = ["".join(draw.choice("ACGT") for _ in range(n)) for n in (0, 3, m, 40, 300, 700)]
    texts += [texts[-1], texts[-1][100:400], texts[-2] + texts[-1][:50]]
    got = {(r.src, r.dst, r.label): (r.n, (r.first_entry, r.first_pos)) for r in graph.text_graph(frame(spark, texts), m).collect()}
    assert got == spelt_graph(texts, m) and (m < 7 or any(len(label) > 16 for *_, label in got))


def test_word_graph_sorts_no_places(spark):
    assert "SortAggregate" not in plan(graph._counted_windows(catalog.text_dna(spark, SF), 5))
    spaces = plan(catalog.QUERIES["g1_x_spaces_whole"](spark, SF))
    assert "BroadcastHashJoin" in spaces and "SortMergeJoin" not in spaces and "SortAggregate" not in spaces


@pytest.mark.parametrize("few", [0, 1 << 24])
@pytest.mark.parametrize("m", [3, 12, 14])
def test_places_of_words(spark, monkeypatch, m, few):
    """Sent around as words, as bits, or merged: the same places."""
    monkeypatch.setattr(kmers, "BROADCAST_BYTES", few)
    draw = random.Random(m)
    texts = ["".join(draw.choice("ACGTACGTACGTACGTN") for _ in range(60)) for _ in range(20)] + ["", "AC"]
    places = kmers.dna_words(frame(spark, texts), m)
    want = [(e, i, t[i : i + m]) for e, t in enumerate(texts, 1) for i in range(len(t) - m + 1) if "N" not in t[i : i + m]]
    assert sorted(map(tuple, places.collect())) == want
    known = sorted({w for *_, w in want})
    chosen = set(known[::3])
    frames = [spark.createDataFrame([(w,) for w in x], "kmer string") for x in (sorted(chosen), [w for w in known if w not in chosen])]
    for rest in (None, frames[1]):
        got = uniq.of_words(places, frames[0], m, rest)
        assert sorted(map(tuple, got.collect())) == [x for x in want if x[2] in chosen]
        assert ("SortMergeJoin" in plan(got)) == (m > 12 and not few)


def test_places_are_not_exchanged(spark):
    for name in ("q18_unique_words_whole", "f8_matches_of_other_groups", "f9_inexact_only", "a16_inexact_words_whole"):
        assert "SortMergeJoin" not in plan(catalog.QUERIES[name](spark, SF))


def test_groups_by_name(spark):
    rows = [(1, "ACGTAC", "x"), (2, "TACGTT", "x"), (3, "CGTTTA", "y"), (4, "GGGGGG", "")]
    df = spark.createDataFrame(rows, "entry_id long, seq string, group string")
    groups = defaultdict(set)
    for _, t, g in rows:
        for i in range(len(t) - 2):
            groups[t[i : i + 3]].add(g)
    want = {(e, i): len(groups[t[i : i + 3]]) > 1 for e, t, _ in rows for i in range(len(t) - 2)}
    assert {tuple(r) for r in uniq.matched_in_others(df, 3).collect()} == {x for x, shared in want.items() if shared}
    assert {tuple(r) for r in uniq.in_one_group(df, 3).collect()} == {x for x, shared in want.items() if not shared}


def test_bitmaps_beyond_the_usual_span(spark, tmp_path):
    """Runs up to, at and beyond place 20,001 are read back as they were written."""
    at = [5, 6, 20000, 20001, 20002, 30000, 30001, 45000]
    spark.createDataFrame([(1, p) for p in at] + [(2, 0), (3, 20001), (4, 20000), (5, 25000)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(1, 5, 2), (1, 20000, 3), (1, 30000, 2), (1, 45000, 1), (2, 0, 1), (3, 20001, 1), (4, 20000, 1), (5, 25000, 1)}
    assert {tuple(r) for r in catalog.QUERIES["s19_bitmap_lines_read"](spark, str(tmp_path)).select("entry_id", "start", "len").collect()} == want


@pytest.mark.parametrize("skip_short", [False, True])
def test_containment_by_brute_force(spark, skip_short):
    """Parts of all lengths around the seeds, equal texts, parts at both ends, and texts that share a beginning."""
    draw = random.Random(3)
    long = "".join(draw.choice("ABC") for _ in range(400))
    texts = [long, long, long[:32], long[:31], long[50:83], long[300:], long[:100] + "X", long[:100] + "Y" + long, long[:100], long[:100], "", "A", "AB", long[7:12], long[7:13], long[:33], "X" * 40, "X" * 64, "X" * 39 + "Y"]
    want = {(a, b) for a, s in enumerate(texts, 1) for b, w in enumerate(texts, 1) if len(s) >= (6 if skip_short else 1) and len(s) < len(w) and s in w}
    got = sorted(map(tuple, uniq.contained(frame(spark, texts), skip_short=skip_short).select("part", "whole").collect()))
    assert got == sorted(want) and len(want) > 40


def test_no_candidate_takes_a_text_along(spark):
    text = plan(uniq.contained(catalog.letters(spark, SF)))
    before = [line for line in text.split("\n") if "Exchange hashpartitioning(mer" in line]
    assert before and "_bits" in text and "short" not in text


@pytest.mark.parametrize(("k", "cells"), [(3, 1 << 22), (3, 8), (13, 1 << 22)])
def test_words_are_counted_by_their_numbers(spark, monkeypatch, k, cells):
    """Counts by entry, over all and on both strands without a row a place: other letters, short, absent and long texts, and one entry in two rows."""
    monkeypatch.setattr(kmers, "_CELLS", cells)
    monkeypatch.setattr(kmers, "_LETTERS", 50)
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("ACGTACGTACGTNα") for _ in range(n))) for i, n in enumerate([0, 2, 13, 300, 70_000, 14])] + [(3, "ACGTTACGTTACGTT"), (9, None)]
    own = spark.createDataFrame(texts, "entry_id long, seq string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    for by_entry, both in ((True, False), (False, False), (False, True)):
        got = kmers.dna_counts(own, k, by_entry, both)
        assert "Generate explode(sequence(0, (length(piece" not in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got) == rows(kmers.count(kmers.dna_words(own, k), by_entry, both)) != []
