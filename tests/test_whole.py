"""Queries over whole tables by brute force on a small fixture."""

import pytest

from strandloom import catalog
from strandloom.functions import seq as S

TEXTS = {1: "MTHENKLRPAAK thens", 2: "then", 3: None, 4: "", 5: "Mtheq, WAYKPRGGGGGGGGGGGGGG! K", 6: "Wayk", 7: "ATHENKLRPAAKTHENSZ", 8: "WAYK"}

LINES = [(3, 1, 4), (4, 1, 9), (4, 1, 9), (1, 1, 5), (10, 1, 2), (7, 2, 8), (9, 2, 8), (8, 2, 20), (5, 3, 5)]


def letters(text):
    return "".join(c for c in (text or "").upper() if "A" <= c <= "Z")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    masses = [S.MONO["W"] + S.MONO["A"] + S.MONO["Y"] + S.MONO["K"], 14 * S.MONO["G"] + S.MONO["K"], 1.0]
    spark.createDataFrame(list(enumerate(masses)), "p_partkey long, p_retailprice double").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{at}/nation.parquet")
    return at


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """Documents whose letters hold whole primers and patterns; the same tables otherwise. The letters of each by id."""
    at = str(tmp_path_factory.mktemp("planted"))
    primers, p = catalog.PRIMERS.split(), {r.pattern_id: r.pattern for r in catalog.patterns(spark, sf).collect()}
    texts = {1: ("AC" * 30).join(primers[:5]), 2: back(primers[1]) + "T" * 50 + primers[0][:-1], 3: p[1] + "A" * 90 + p[2] + "G" * 9 + back(p[2]) + "C" * 1500 + back(p[1]), 4: p[4] + "A" * 2000 + p[3] + p[4], 5: ""}
    spark.createDataFrame([(i, t.translate(str.maketrans("ACGT", "ABCD"))) for i, t in texts.items()], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(f"{at}/nation.parquet")
    return at, texts, p


def back(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def places(seq, word):
    return [i for i in range(len(seq) - len(word) + 1) if seq.startswith(word, i)]


def digest(seq, missed=1):
    parts, cut = [], 0
    for i in range(1, len(seq) + 1):
        if i == len(seq) or seq[i - 1] in "KR" and seq[i] != "P":
            parts.append(seq[cut:i])
            cut = i
    found = {"".join(parts[i : i + n]) for i in range(len(parts)) for n in range(1, missed + 2)}
    first = {"".join(parts[:n]) for n in range(1, missed + 2)}
    return found | {p[1:] for p in first if p.startswith("M") and len(p) > 1}


def test_a8_digest(spark, sf):
    peptides = set().union(*(digest(letters(t)) for t in TEXTS.values())) - {""}
    known = [sum(S.MONO[c] for c in p) for p in peptides if all(c in S.MONO for c in p)]
    got = {r.query: (r.mw, r.n) for r in catalog.QUERIES["a8_peptide_multiplicity"](spark, sf).collect()}
    assert len(got) == 3 and got[0][1] >= 1 and got[2][1] == 0
    assert all(n == sum(abs(mw - m) <= 0.1 for m in known) for mw, n in got.values())


def test_j13_whole(spark, sf):
    windows = {s[i : i + 4] for s in map(letters, TEXTS.values()) for i in range(len(s) - 3)}
    distance = S.amino_distance_map()
    got = {r.peptide: r.cost for r in catalog.QUERIES["j13_mutation_cost"](spark, sf).collect()}
    assert got == {w: sum(0 if a == b else distance.get(a + b, 3) for a, b in zip(w, "THEN", strict=True)) for w in windows}
    assert got["THEN"] == 0 and any(not w.startswith("TH") for w in got)


def test_asof_whole(spark, sf):
    for name, of, best in (("j22_last_at_most", lambda key, place: key <= place, max), ("j23_first_at_least", lambda key, place: key >= place, min)):
        want = [(k, place, best((key for _, j, key in LINES if j == k and of(key, place)), default=None)) for place, k, _ in LINES]
        assert sorted(map(repr, want)) == sorted(repr((r.k, r.place, r.found)) for r in catalog.QUERIES[name](spark, sf).collect())


def test_containment_of_documents(spark, sf):
    own = {i: letters(t) for i, t in TEXTS.items()}
    want = {(a, b) for a, s in own.items() for b, w in own.items() if s and len(s) < len(w) and s in w}
    assert {(r.part, r.whole) for r in catalog.QUERIES["j20_containment"](spark, sf).collect()} == want and len(want) >= 4
    seqs = [*own.values()]
    top = {s for s in seqs if s and not any(len(s) < len(w) and s in w for w in seqs)}
    got = {r.seq: r.n for r in catalog.QUERIES["t4_non_redundant_with_containment"](spark, sf).collect()}
    assert {s: n for s, n in got.items() if s} == {s: sum(bool(x) and x in s for x in seqs) for s in top}


def test_whole_primers(spark, planted):
    at, texts, _ = planted
    want = {(i, strand): (w, sum(len(places(t, w)) for t in texts.values())) for i, p in enumerate(catalog.PRIMERS.split(), 1) for strand, w in (("F", p), ("R", back(p)))}
    got = {(r.base_id, r.strand): (r.pattern, r.n) for r in catalog.QUERIES["q1_primer_match_counts"](spark, at).collect()}
    assert got == want and sum(n for _, n in want.values()) >= 6 and any(n == 0 for _, n in want.values())


def test_whole_pairs(spark, planted):
    at, texts, p = planted
    both = p | {i + 25: back(x) for i, x in p.items()}
    roles = [(k, a, b) for k in range(1, 13) for a, b in ((2 * k - 1, 2 * k), (2 * k + 25, 2 * k + 24))]
    want = [(e, k, i, j + len(both[b]), t[i : j + len(both[b])]) for e, t in texts.items() for k, a, b in roles for i in places(t, both[a]) for j in places(t, both[b]) if i <= j and j + len(both[b]) - i <= 2000]
    got = [(r.entry_id, r.pair_id, r.start_pos, r.end_pos, r.amplicon) for r in catalog.QUERIES["q2_pcr_match_whole"](spark, at).collect()]
    assert sorted(got) == sorted(want) and len({len(x[-1]) for x in want}) >= 2
    assert catalog.QUERIES["j15_primer_pairs_whole"](spark, at).count() == catalog.QUERIES["r3_pair_lines_whole"](spark, at).count() == len(want)


def test_mismatches_in_whole_texts(spark, planted):
    at, texts, p = planted
    near = lambda w, t: sum(a != b for a, b in zip(w, t, strict=True))
    want = {(e, i, at_, n) for e, t in texts.items() for i, w in p.items() for at_ in range(len(t) - len(w) + 1) if (n := near(w, t[at_ : at_ + len(w)])) <= 2}
    rows = catalog.QUERIES["j6_mismatches_whole"](spark, at).collect()
    assert {(r.entry_id, r.pattern_id, r.start_pos, r.edits) for r in rows} == want and len(rows) == len(want) >= 6
    assert sum(r.n for r in catalog.QUERIES["a1_counts_by_edits_whole"](spark, at).collect()) == len(want)


def test_unique_words_of_whole_texts(spark, planted):
    at, texts, _ = planted
    words = [(e, i, t[i : i + 9]) for e, t in texts.items() for i in range(len(t) - 8)]
    seen = [x for *_, w in words for x in (w, back(w))]
    want = {x for x in words if seen.count(x[2]) == 1}
    assert {tuple(r) for r in catalog.QUERIES["q18_unique_words_whole"](spark, at).select("entry_id", "pos", "kmer").collect()} == want


def test_all_reach_whole_texts():
    assert {f"{f.__name__}_whole" for f in (*catalog.WHOLE, *catalog.WHOLE_WITHOUT_SQL)} <= set(catalog.QUERIES)
    for f in catalog.WHOLE:
        assert "from dna" not in catalog.ORACLE_SQL[f"{f.__name__}_whole"] and "text_dna" in catalog.ORACLE_SQL[f"{f.__name__}_whole"]


def test_q15_pairs_seen_lists_no_places(spark, sf):
    """The pairs of one gap, counted in tables without a row a place."""
    from strandloom.operators import kmers

    got = catalog.QUERIES["q15_pairs_seen"](spark, sf)
    assert "Generate explode(sequence(0, (length(piece" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in kmers.seen(kmers.pair_codes(catalog.text_dna(spark, sf), 3, 5), 3).collect()]
