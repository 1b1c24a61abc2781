"""Composed programs and plans by brute force: long entries, borders of pieces, absolute places, spaced seeds, database forms."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import align, graph, kmers, match, programs, runs
from strandloom.plans import formats
from strandloom.sources import files


@pytest.fixture(scope="module")
def entries():
    rnd = random.Random(8)
    return {1: "".join(rnd.choice("ACGT") for _ in range(700)), 2: "ACGTACGTTT", 3: "", 4: "A" * 300 + "C" + "A" * 40, 5: "GATTACA"}


@pytest.fixture(scope="module")
def sequences(spark, entries):
    return spark.createDataFrame(list(entries.items()), "entry_id long, seq string").cache()


@pytest.fixture(scope="module")
def patterns(spark, entries):
    words = [entries[1][100:112], entries[1][3:10] + "A", "ACGT", "TTT", "AC", entries[1][-9:], "GATTACAGATTACA"]
    return spark.createDataFrame(list(enumerate(words, 1)), "pattern_id long, pattern string").cache()


def hits(entries, words, k):
    return {(e, i, at, sum(a != b for a, b in zip(w, s[at : at + len(w)], strict=True))) for e, s in entries.items() for i, w in words for at in range(len(s) - len(w) + 1) if sum(a != b for a, b in zip(w, s[at : at + len(w)], strict=True)) <= k}


def test_matching_with_windows(spark, sequences, entries, patterns, monkeypatch):
    words = [tuple(r) for r in patterns.collect()]
    for long, short in ((1 << 15, 1 << 7), (64, 16)):
        monkeypatch.setattr(kmers, "LONG", long)
        monkeypatch.setattr(kmers, "SHORT", short)
        assert {(r.entry_id, r.pattern_id, r.start_pos, r.edits) for r in match.exact(sequences, patterns).collect()} == hits(entries, words, 0)
        longer = [w for w in words if len(w[1]) > 2]
        got = match.found(sequences, patterns.where("length(pattern) > 2"), 1, None, 2).collect()
        assert {(r.entry_id, r.pattern_id, r.start_pos, r.edits) for r in got} == hits(entries, longer, 1) and len(got) == len(hits(entries, longer, 1))
        for r in got:
            padded = "\0\0" + entries[r.entry_id] + "\0\0"
            assert (r.before, r.text, r.after) == (padded[r.start_pos : r.start_pos + 2], padded[r.start_pos + 2 : r.end_pos + 2], padded[r.end_pos + 2 : r.end_pos + 4])
    assert match.exact(sequences, patterns.limit(0)).collect() == [] and match.found(sequences, patterns.limit(0), 1).collect() == []


def test_runs_across_pieces(spark, sequences, entries, monkeypatch):
    want = {(e, c, sum(len(list(g)) for _, g in groups[:i]), len(list(groups[i][1]))) for e, s in entries.items() for groups in [[(c, list(g)) for c, g in itertools.groupby(s)]] for i, (c, _) in enumerate(groups)}
    for short in (1 << 7, 10):
        monkeypatch.setattr(kmers, "SHORT", short)
        for least in (1, 3, 200):
            assert {tuple(r) for r in runs.runs(sequences, least, None).select("entry_id", "symbol", "start", "len").collect()} == {x for x in want if x[3] >= least}


def test_one_long_entry_is_linear(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("ACGT") for _ in range(1_000_000))
    one = spark.createDataFrame([(1, text)], "entry_id long, seq string")
    word = spark.createDataFrame([(1, text[777_000:777_016])], "pattern_id long, pattern string")
    began = time.time()
    assert (777_000, 0) in {(r.start_pos, r.edits) for r in match.mismatches(one, word, 1).collect()}
    assert runs.runs(one, 9, None).count() == sum(len(list(g)) >= 9 for _, g in itertools.groupby(text))
    assert time.time() - began < 240


def test_absolute_places(spark, sequences, entries):
    placed = files.with_absolute_starts(sequences).cache()
    starts, at = {}, 1
    for e, s in sorted(entries.items()):
        starts[e], at = at, at + len(s) + 1
    assert {r.entry_id: r.abs_start for r in placed.collect()} == starts
    wanted = [(-1, starts[4] + 295, 10), (-1, starts[5] - 1, 1), (1, 690, 10), (1, 691, 10), (3, 0, 0), (-1, starts[2], 4)]
    got = runs.extract(placed, spark.createDataFrame(wanted, "entry_id long, start long, length long"))
    assert sorted((r.entry_id, r.start, r.text) for r in got.collect()) == sorted([(4, 295, "AAAAACAAAA"), (1, 690, entries[1][690:]), (3, 0, ""), (2, 0, "ACGT")])


def test_pcr_and_peptides(spark, sequences, entries):
    left, right = entries[1][50:62], entries[1][300:312]
    turned = right[::-1].translate(str.maketrans("ACGT", "TGCA"))
    primers = spark.createDataFrame([(1, left[:5] + "A" + left[6:]), (2, right), (3, "CCCCCCCCCCCC"), (4, turned)], "pattern_id long, pattern string")
    sts = spark.createDataFrame([(1, 250, 258)], "pair_id long, size_lb long, size_ub long")
    (a,) = programs.pcr_match(sequences, primers, 1, sts=sts, tolerance=4).where("left_id = 1").collect()
    assert (a.entry_id, a.start_pos, a.end_pos, a.length, a.deviance, a.amplicon) == (1, 50, 312, 262, 4, entries[1][50:312])
    assert programs.pcr_match(sequences, primers, 1, sts=sts, tolerance=3).where("left_id = 1").collect() == []
    hit = programs.primer_match(sequences, primers.where("pattern_id = 4"), 0).where("strand = 'R'").first()
    assert (hit.start, hit.five, hit.three, hit.text_forward, hit.ops) == (300, 312, 300, turned, "|" * 12)
    proteins = spark.createDataFrame([(1, "MKTAYIAK"), (2, "TAY")], "entry_id long, seq string")
    peptides = spark.createDataFrame([(1, "TAY"), (2, "TSY")], "pattern_id long, pattern string")
    got = {(r.entry_id, r.pattern_id): r for r in programs.peptide_scan(proteins, peptides, 1, 3).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)} and (got[1, 1].left_context, got[1, 1].right_context) == ("-MK", "IAK") and got[2, 2].left_context == "-"
    assert got[1, 2].cost == 1 and got[1, 2].mass_difference == pytest.approx(S.MONO["A"] - S.MONO["S"])


def test_spaced_seeds_miss_nothing(spark, sequences, entries):
    templates = programs.covering(8, 2, 4)
    assert all(any(all(t[i] == "0" for i in x) for t in templates) for x in itertools.combinations(range(8), 2))
    with pytest.raises(ValueError):
        programs.covering(8, 2, 7)
    words = [(1, entries[1][20:29]), (2, "ACGTACGT"), (3, "AAACAAAA")]
    got = programs.spaced_mismatches(sequences, spark.createDataFrame(words, "pattern_id long, pattern string"), 2, templates).collect()
    assert {(r.entry_id, r.pattern_id, r.start_pos, r.edits) for r in got} == hits(entries, words, 2)


def test_database_forms(spark, tmp_path):
    base = str(tmp_path / "db.fasta")
    with open(base, "w") as out:
        out.write(">a one\nACGX\n>b\nTT\n")
    assert [r.seq for r in files.read_best(spark, base).orderBy("entry_id").collect()] == ["ACGX", "TT"]
    assert files.compress(spark, base, check=True) and files.compress(spark, base) and not files.compress(spark, base) and files.compress(spark, base, force=True)
    assert files.compress(spark, base, "ACGT")
    assert [r.seq for r in files.read_best(spark, base).orderBy("entry_id").collect()] == ["ACGN", "TT"]
    assert set(files.forms(spark, base)) == {"text", "table", "normalised"}
    sts = spark.createDataFrame([("z", "AC", "GT"), ("b", "CC", "GG")], "id string, fwd string, rev string")
    assert sorted(map(tuple, files.sts_patterns(sts).collect())) == [(1, 1, "CC"), (1, 2, "GG"), (2, 3, "AC"), (2, 4, "GT")]


def test_small_functions(spark):
    pairs = [(12, 18), (0, 5), (0, 0), (-4, 6), (2**62, 6), (1, 1)]
    rows = spark.createDataFrame(pairs, "a long, b long").select(S.gcd("a", "b").alias("g"), S.lcm("a", "b").alias("l")).collect()
    assert [r.g for r in rows] == [math.gcd(a, b) for a, b in pairs] and [r.l for r in rows] == [math.lcm(a, b) if a < 2**60 else None for a, b in pairs]
    assert S.contains_letter("N", "R") and S.contained_letter("A", "R") and not S.contains_letter("R", "N")
    d = spark.createDataFrame([("ATG", "M"), ("ATG", "I"), ("TTT", "K"), ("XXX", "K")], "c string, a string").select(S.codon_distance("c", "a").alias("d"))
    assert [r.d for r in d.collect()] == [0, 1, 3, None]
    parts = spark.createDataFrame([(1, ["ab", "c", "", "defg", "h"]), (2, [])], "id long, p array<string>")
    got = kmers.with_offsets(parts.select("id", "p"), parts["p"], 1).orderBy("i").collect()
    assert [(r.i, r.offset, r.own) for r in got] == [(0, 0, ["ab", "c"]), (1, 2, ["c", ""]), (2, 3, ["", "defg"]), (3, 3, ["defg", "h"]), (4, 7, ["h"])]
    assert formats.wig_header(None).split()[2] == "name=mer-cnt"


def test_shortcuts_are_shortest_paths(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(12), rnd.randrange(12), "ACGT"[: rnd.randint(1, 3)], rnd.randint(1, 2)) for _ in range(20)]
    edges = spark.createDataFrame(rows, "src long, dst long, label string, n long")
    surplus = {x: sum(n * ((a == x) - (b == x)) for a, b, _, n in rows) for x in range(12)}
    far = {(a, b): 0 if a == b else math.inf for a in range(12) for b in range(12)}
    for a, b, label, _ in rows:
        far[a, b] = min(far[a, b], len(label))
    for via, a, b in itertools.product(range(12), repeat=3):
        far[a, b] = min(far[a, b], far[a, via] + far[via, b])
    for longest in (1, 4, 30):
        want = {(a, b, c) for (a, b), c in far.items() if surplus[a] < 0 < surplus[b] and c <= longest}
        got = {tuple(r) for r in graph.shortcuts(edges, longest).select("src", "dst", "cost").collect()}
        assert got == want
        nearest = {x for x in want if sum((c, a) < (x[2], x[0]) for a, b, c in want if b == x[1]) < 2}
        assert {tuple(r) for r in graph.shortcuts(edges, longest, most=2).select("src", "dst", "cost").collect()} == nearest
    assert graph.shortcuts(edges.limit(0), 3).collect() == []
    units = graph.degrees(edges).where("surplus != 0").withColumn("component", F.lit(1))
    flow = graph.transported(units.select("component", "node", "surplus"), graph.shortcuts(edges, 30).withColumn("component", F.lit(1)).select("component", "src", "dst", "cost")).collect()
    assert all(sum(r.units for r in flow if r.src == x) <= max(-surplus[x], 0) and sum(r.units for r in flow if r.dst == x) <= max(surplus[x], 0) for x in range(12))


def least_edits(text, pattern):
    row = list(range(len(text) + 1))
    for i, p in enumerate(pattern, 1):
        row, last = [i], row
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_anchored_alignments():
    rnd = random.Random(4)
    for _ in range(200):
        seq, right = "".join(rnd.choices("ACG", k=20)), "".join(rnd.choices("ACG", k=5))
        found = align.anchored(seq, seq[4:8], right, 2, left_end=8)
        best = min(least_edits(seq[8:e], right) for e in range(8, 16))
        assert (found is None) == (best > 2)
        if found:
            start, end, edits, text, ops, pattern = found
            assert (start, edits, text.replace("-", ""), pattern.replace("-", "")) == (4, best, seq[4:end], seq[4:8] + right)
            assert least_edits(seq[8:end], right) == best and sum(x not in "|+" for x in ops) == best and ops.startswith("||||")
        found = align.anchored(seq, right, seq[12:16], 2, right_end=16)
        best = min(least_edits(seq[s:12], right) for s in range(4, 13))
        assert (found is None) == (best > 2)
        if found:
            start, end, edits, text, ops, pattern = found
            assert (end, edits, text.replace("-", ""), pattern.replace("-", "")) == (16, best, seq[start:16], right + seq[12:16])
    assert align.anchored("ACGT", "A", "CCGT", 1, right_end=2) is None


def test_two_pieces(spark):
    cases = [
        ("TTACGTGGCATT", "ACGT", "GGCA", 6, 10, (2, 10, 0, "ACGTGGCA", "||||||||", "ACGTGGCA")),
        ("TTACGTCGGCATT", "ACGT", "GGCA", 6, 11, (2, 11, 1, "ACGTCGGCA", "||||^||||", "ACGT-GGCA")),
        ("TTACGTGCATT", "ACGT", "GGCA", 6, 9, (2, 9, 1, "ACGT-GCA", "||||v|||", "ACGTGGCA")),
        ("TTACGGGCATT", "ACGT", "GGCA", 6, 9, (2, 9, 1, "ACG-GGCA", "|||v||||", "ACGTGGCA")),
        ("TTACGAGCATT", "ACGT", "GGCA", 6, 9, (2, 9, 2, "ACGA-GCA", "|||*v|||", "ACGTGGCA")),
        ("TTACGTTTGGCATT", "ACGT", "GGCA", 6, 12, None),
        ("GT", "ACGT", "GGCA", 2, 6, None),
        (None, "ACGT", "GGCA", 2, 6, None),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, seq string, l string, r string, a long, b long")
    got = {r.i: tuple(r.x) if r.x else None for r in df.select("i", align.two_piece("seq", "l", "r", "a", "b").alias("x")).collect()}
    assert got == {i: c[5] for i, c in enumerate(cases)}
    held = df.select("i", align.two_piece("seq", "l", "r", "a", "b", left_exact=4).alias("x")).where("x is not null").collect()
    assert [r.i for r in held] == [0]
    wild = df.where("i = 4").select(align.two_piece("seq", F.lit("ACGN"), "r", "a", "b", wildcards=True).alias("x")).first().x
    assert (wild.edits, wild.ops) == (1, "|||+v|||")


def test_comparing_equals_seeds(spark, monkeypatch):
    """Few patterns are compared with all places, without a row a place; the hits are those of the seeds, over pieces and blocks of any size."""
    monkeypatch.setattr(match, "OWN", 16)
    monkeypatch.setattr(match, "AT_ONCE", 50)
    rnd = random.Random(21)
    texts = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (0, 3, 7, 16, 17, 90, 200)] + ["ACGTÄACGTACÖGTACGT", "ACGTACG\U0001f600ACGTACGTA"]
    sequences = spark.createDataFrame([*enumerate(texts), (99, None)], "entry_id long, seq string")
    patterns = spark.createDataFrame([(1, "ACGTA"), (2, "CGTACGT"), (3, "TTGAC"), (4, "ACGTACGTA")], "pattern_id long, pattern string")
    ways = [lambda k=k, w=w, c=c: match.found(sequences, patterns, k, w, c) for k, w, c in ((1, None, 2), (2, None, 0), (2, 3, 1), (0, None, 3))] + [lambda t=t: match.edit_ends(sequences, patterns, 1, with_text=t) for t in (False, True)]
    few = [way() for way in ways]
    assert all("Generate explode(sequence(0, (length(piece" not in d._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in d._jdf.queryExecution().executedPlan().toString() for d in few)
    got = [sorted(map(tuple, d.collect())) for d in few]
    monkeypatch.setattr(match, "DIRECT_LETTERS", 0)
    assert got == [sorted(map(tuple, way().collect())) for way in ways] and all(got)
