"""Words of several entries or groups, told by tables: by brute force, and without a row a place."""

import random
from collections import defaultdict

import pytest

from strandloom import catalog
from strandloom.operators import runs, shared, uniq

SF = "/root/testdata/sf0.001"


def back(w):
    return w[::-1].translate(str.maketrans("ACGT", "TGCA"))


def drawn(seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choice("ACGTACGTACGTN") for _ in range(n)) for n in (0, 3, 40, 90, 40, 70_000)]
    return [*texts, texts[3][20:60], texts[2] + texts[2], "ACGTTTTGCAAA" * 2]


def words(texts, m):
    return [(e, i, t[i : i + m]) for e, t in enumerate(texts, 1) for i in range(len(t) - m + 1) if "N" not in t[i : i + m]]


@pytest.mark.parametrize("m", [5, 8])
def test_owners(spark, m):
    texts = drawn(m)
    df = spark.createDataFrame([(e, t, e % 2) for e, t in enumerate(texts, 1)], "entry_id long, seq string, group int").repartition(3)
    number = lambda w: sum("ACGT".index(c) * 4**i for i, c in enumerate(reversed(w)))
    for of, frame in ((lambda e: e, df.drop("group")), (lambda e: e % 2, df)):
        found = defaultdict(set)
        for e, _, w in words(texts, m):
            found[number(w)].add(of(e))
        seen, again = shared.owners(frame, m)
        assert set(seen.nonzero()[0].tolist()) == set(found) and set(again.nonzero()[0].tolist()) == {w for w, s in found.items() if len(s) > 1}


@pytest.mark.parametrize(("m", "k", "both"), [(6, 0, False), (6, 1, True), (8, 1, False), (8, 0, True)])
def test_matched_elsewhere_by_tables(spark, m, k, both):
    """Places by the definition, listed and counted; one entry in two rows too."""
    texts = [t[:300] for t in drawn(9)]
    for split in (False, True):
        rows = list(enumerate(texts, 1)) + ([(4, texts[2])] if split else [])
        places = [(e, i, t[i : i + m]) for e, t in rows for i in range(len(t) - m + 1) if "N" not in t[i : i + m]]
        strands = [(e, i, x) for e, i, w in places for x in ((w, back(w)) if both else (w,))]
        near = lambda a, b: a[:2] == b[:2] and a[-1] == b[-1] and sum(x != y for x, y in zip(a, b, strict=True)) <= k
        want = sorted((e, i) for e, i, w in places if any((f != e or abs(j - i) >= m) and near(w, x) for f, j, x in strands))
        df = spark.createDataFrame(rows, "entry_id long, seq string")
        options = {"both_strands": both, "left": 2, "right": 1}
        got = uniq.matched_elsewhere(df, df, m, k, same=True, **options)
        assert sorted(map(tuple, got.select("entry_id", "pos").collect())) == want
        n = defaultdict(int)
        for e, _ in want:
            n[e] += 1
        assert {r.entry_id: r.n for r in uniq.n_matched_elsewhere(df, m, k, **options).collect()} == n and len(n) > 3


def test_no_place_is_listed(spark):
    for name in ("f8_matches_of_other_groups", "j19_matched_elsewhere_whole", "q18_matched_within_one", "w3_unmatched_regions_whole"):
        assert "Generate explode(sequence(0, (length(piece" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_document_in_two_languages(spark, tmp_path):
    """One number in two rows: each of its words counts for each language that the number has, as SQL's join has it."""
    rows = [(1, "ACGTACGTACGTAA", "en"), (1, "TTGCATTGCATT", "de"), (2, "ACGTACGTACGT", "en"), (3, "CCCCCCCCCCCC", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    of = str.maketrans(*catalog._AZ)
    own = [(e, t.translate(of), x or "") for e, t, _ in rows for f, _, x in rows if e == f]
    groups, n = defaultdict(set), defaultdict(int)
    for _, t, g in own:
        for i in range(len(t) - 9):
            groups[t[i : i + 10]].add(g)
    for e, t, _ in own:
        for i in range(len(t) - 9):
            n[e] += len(groups[t[i : i + 10]]) > 1
    got = {r.entry_id: r.n for r in catalog.QUERIES["f8_matches_of_other_groups"](spark, str(tmp_path)).collect()}
    assert got == {e: x for e, x in n.items() if x} and len(got) == 2


def chains(rows, motifs, least):
    out = []
    for e, t in rows:
        for i, p in motifs:
            hits = {a for a in range(len(t) - len(p) + 1) if t.startswith(p, a)}
            for a in sorted(hits):
                if a - len(p) not in hits:
                    n = 1
                    while a + n * len(p) in hits:
                        n += 1
                    if n >= least:
                        out.append((e, i, a, n, n * len(p)))
    return sorted(out)


def test_tandems_without_a_row_a_hit(spark):
    """Chains within, across and at the borders of pieces, and of motifs that overlap themselves."""
    draw = random.Random(4)
    texts = ["", "A", "ACACAC", "AAAAAAA", "é" + "AC" * 5, "G" * (1 << 15) + "AC" * 40, "C" * 32_766 + "ACACACA", "A" * 70_001, "T" + "AC" * 50_000, "".join(draw.choice("AC") for _ in range(66_000))]
    motifs = [(1, "AC"), (2, "AA"), (3, "CAC"), (4, "C")]
    rows = list(enumerate(texts, 1))
    frames = spark.createDataFrame(rows, "entry_id long, seq string"), spark.createDataFrame(motifs, "pattern_id long, pattern string")
    got = runs.tandem_motifs(*frames, min_copies=3)
    assert sorted(map(tuple, got.select("entry_id", "pattern_id", "start", "copies", "length").collect())) == chains(rows, motifs, 3)
    plan = catalog.QUERIES["w7_tandem_repeats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "start_pos" not in plan and "explode(" not in plan
