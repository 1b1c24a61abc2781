"""Alignments, graphs, formats, sources and streams by brute force and worked examples."""

import itertools
import random
from collections import Counter

import pytest

from strandloom.functions import seq as S
from strandloom.operators import align, graph, kmers, match, pairs, runs
from strandloom.plans import chooser, formats
from strandloom.sources import files
from strandloom.streaming import per_entry

GOLDEN = [
    ("AGCTG-GTGGG", "|||||v|||||", "AGCTGYGTGGG"),
    ("ACCGAGGAGGA", "||*||+|||||", "ACAGAKGAGGA"),
    ("TGGATAATTTTT", "+++|^|+||||+", "WRRA-AWTTTTW"),
    ("CGCCRGCACGAGTT", "||||+|||^|||||", "CGCCAGCA-GAGTT"),
    ("CTCAGATCTGA-TG", "|||||||||||v||", "CTCAGATCTGACTG"),
    ("CTTGTAATCCCAGAACTTTGG", "||^||||||||||*|||||||", "CT-GTAATCCCAGGACTTTGG"),
]


@pytest.mark.parametrize("text, ops, pattern", GOLDEN)
def test_worked_alignments(text, ops, pattern):
    plain = text.replace("-", "")
    found = align.align(plain, pattern.replace("-", ""), len(plain), len(plain), 2, wildcards=True)
    assert found == (0, len(plain), sum(c in "^v*" for c in ops), text, ops, pattern)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_alignments_are_the_best():
    rnd = random.Random(1)
    for _ in range(300):
        text, pattern = ("".join(rnd.choice("ACGT") for _ in range(n)) for n in (14, 6))
        end = rnd.randint(1, 14)
        best = min(distance(text[s:end], pattern) for s in range(max(0, end - 8), end + 1))
        found = align.align(text, pattern, end, end, 2)
        assert (found[2] if found else None) == (best if best <= 2 else None)
        if found:
            assert found[1] == end and text[found[0] : end] == found[3].replace("-", "") and pattern == found[5].replace("-", "")


def test_alignment_constraints():
    assert align.align("ACGTACGA", "ACGTACGT", 8, 8, 1)[2] == 1
    assert align.align("ACGTACGA", "ACGTACGT", 8, 8, 1, right=2) is None
    assert align.align("AGGTACGT", "ACGTACGT", 8, 8, 1, left=2) is None
    assert align.align("TLK", "TIK", 3, 3, 1, mutations=True)[4] in ("|.|", "|:|")


def test_edge_cases(spark):
    rows = [(1, ""), (2, "ACG"), (3, "ACGTACGT"), (4, None), (5, "acgtacgt"), (6, "TTACGTA"), (7, "CGTTT")]
    entries = spark.createDataFrame(rows, "entry_id long, seq string").withColumnRenamed("seq", "seq")
    pats = spark.createDataFrame([(1, "ACGTACGT"), (2, "CGT"), (3, "GGGG"), (4, "CGT")], "pattern_id long, pattern string")
    hits = {(r.entry_id, r.pattern_id, r.start_pos) for r in match.exact(entries, pats).collect()}
    assert hits == {(3, 1, 0), (3, 2, 1), (3, 2, 5), (3, 4, 1), (3, 4, 5), (6, 2, 3), (6, 4, 3), (7, 2, 0), (7, 4, 0)}
    assert {r.pattern_id: r.n for r in match.counts(match.exact(entries, pats), pats).collect()} == {1: 1, 2: 4, 3: 0, 4: 4}
    assert match.exact(entries.limit(0), pats).collect() == [] and match.exact(entries, pats.limit(0)).collect() == []
    with pytest.raises(ValueError):
        chooser.choose(chooser.statistics(pats), k=3)


def test_long_entries_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(kmers, "LONG", 64)
    monkeypatch.setattr(kmers, "SHORT", 16)
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("ACGTN") for _ in range(n))) for i, n in enumerate((0, 3, 15, 16, 17, 64, 65, 300))]
    got = sorted(tuple(r) for r in kmers.words(spark.createDataFrame(rows, "entry_id long, seq string"), 4).collect())
    assert got == [(i, p, s[p : p + 4]) for i, s in rows for p in range(len(s) - 3)]


def test_strategies_agree(spark):
    rnd = random.Random(4)
    entries = spark.createDataFrame([(i, "".join(rnd.choice("ACGT") for _ in range(60))) for i in range(20)], "entry_id long, seq string").cache()
    pats = spark.createDataFrame([(i, "".join(rnd.choice("ACGT") for _ in range(7))) for i in range(1, 6)], "pattern_id long, pattern string").cache()
    place = lambda df: {(r.entry_id, r.pattern_id, r.start_pos) for r in df.collect()}
    assert place(match.exact(entries, pats)) == place(match.scan(entries, [tuple(r) for r in pats.collect()]))
    texts, ps = {r.entry_id: r.seq for r in entries.collect()}, {r.pattern_id: r.pattern for r in pats.collect()}
    for k in (1, 2):
        want = {(e, p, i) for e, s in texts.items() for p, q in ps.items() for i in range(len(s) - 6) if sum(a != b for a, b in zip(s[i:], q)) <= k}
        assert place(match.mismatches(entries, pats, k)) == want
    odd = spark.createDataFrame([(1, "ANGRT")], "pattern_id long, pattern string")
    assert place(match.exact(entries, match.expanded(odd))) == place(match.scan(entries, [(1, "ANGRT")]))


def test_pair_roles():
    assert pairs.roles(2) == [(1, 1, 2), (1, 4, 3)]
    assert len(pairs.roles(4, all_orientations=True)) == 16


def test_tours_and_balance(spark):
    words = [("a", "b", "x", 2), ("b", "c", "y", 1), ("b", "a", "z", 1), ("c", "b", "w", 1), ("p", "q", "v", 1)]
    edges = spark.createDataFrame(words, "src string, dst string, label string, n long")
    nodes = graph.numbered_graph(edges)
    rows = graph.euler_tours(nodes).collect()
    assert Counter(r.label for r in rows if r.label) == {"x": 2, "y": 1, "z": 1, "w": 1, "v": 1}
    for component in {r.component for r in rows}:
        path = sorted((r.step, r.src, r.dst) for r in rows if r.component == component)
        assert all(a[2] == b[1] for a, b in itertools.pairwise(path))
    closed = graph.balance(nodes, close=True).collect()
    surplus = {r.node: r.surplus for r in graph.degrees(nodes).collect()}
    for r in closed:
        surplus[r.src] += 1
        surplus[r.dst] -= 1
    assert not any(surplus.values())


def test_transport_is_cheapest():
    rnd = random.Random(5)
    for _ in range(20):
        costs = {(a, b): rnd.randint(1, 9) for a in range(3) for b in range(3)}
        supply, demand = dict.fromkeys(range(3), 1), dict.fromkeys(range(3), 1)
        best = min(sum(costs[a, p[a]] for a in range(3)) for p in itertools.permutations(range(3)))
        flow = graph.transport(supply, demand, costs)
        assert sum(flow.values()) == 3 and sum(costs[e] * u for e, u in flow.items()) == best
        for method in ("greedy", "vogel"):
            assert sum(graph.transport(supply, demand, costs, method).values()) == 3


def test_formats(spark):
    df = spark.createDataFrame([(1, 5, "x", None)], "start long, length long, pattern string, defline string")
    line = lambda f: df.select(formats.compile_format(f, formats.ALIGNMENT).alias("x")).first().x
    assert line("%s-%l\\t%q|%h|%%%z\\n") == "1-5\tx||%z\n"


def test_sources(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("# note\n>one first entry\nACGT\nacgt\n\n>two\tx\nNNA CG\n>three\n")
    got = [tuple(r) for r in files.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("entry_id").collect()]
    assert got == [(1, "one first entry", "one", "ACGTACGT", 8), (2, "two\tx", "two", "NNACG", 5), (3, "three", "three", "", 0)]
    (tmp_path / "p.txt").write_text("ACG  TTT\n\nGGG\n")
    assert [tuple(r) for r in files.read_patterns(spark, str(tmp_path / "p.txt")).orderBy("pattern_id").collect()] == [(1, "ACG"), (2, "TTT"), (3, "GGG")]
    (tmp_path / "s.sts").write_text("4755\tAAGG\tAATT\t251-252\tD12\t12\tG03884\tHomo sapiens\n1\tAC\tGT\t90\ta\tb\tc\td\n")
    sts = files.read_sts(spark, str(tmp_path / "s.sts")).collect()
    assert [(r.size_lb, r.size_ub, r.species) for r in sts] == [(251, 252, "Homo sapiens"), (90, 90, "d")]
    (tmp_path / "e.txt").write_text("E 1 2 3 9 4\n5 6 7 8 2\n1 2 3 4 5 6 7\n")
    assert sorted(tuple(r) for r in files.read_edges(spark, str(tmp_path / "e.txt")).collect()) == [(1, 2, 3, 9, 4), (1, 2, 4, 6, 7), (5, 6, 7, 8, 2)]
    found = spark.createDataFrame([(1, 0, 2), (1, 5, 1)], "entry_id long, start long, len long")
    spans = spark.createDataFrame([(1, 8), (2, 3)], "entry_id long, size long")
    lines = files.bitmap_lines(found, spans)
    assert {r.entry_id: r.line for r in lines.collect()} == {1: "BEGIN 8 0 2 3 1 2 END", 2: "BEGIN 3 3 END"}
    assert sorted(map(tuple, files.read_bitmap_lines(lines).select("entry_id", "start", "len").collect())) == [(1, 0, 2), (1, 5, 1)]
    a, b = (files.random_genome(spark, 5, 40, 3).repartition(n).orderBy("entry_id").collect() for n in (1, 4))
    assert a == b


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ACGTACG"), (2, "TTACG")], "entry_id long, seq string")
    rows.write.parquet(str(tmp_path / "in"))
    pats = spark.createDataFrame([(1, "ACG")], "pattern_id long, pattern string")
    stream = per_entry.exact_hits(per_entry.read_entries(spark, str(tmp_path / "in"), "entry_id long, seq string"), pats)
    per_entry.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    per_entry.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(match.exact(rows, pats).collect())


def test_scalar_helpers():
    assert S.truth("Yes") and not S.truth("off")
    assert S.template_facts("1101011")["runs"] == [2, 1, 2] and S.template_facts("1010")["period"] == 2
    assert S.codon_amino_distance("TTT", "L") == 1 and S.amino_distance_map()["MW"] == 2
    assert S.to_regex("AN", text_n=False) == "[AHDMNRVWX]".replace("N", "")[:0] + S.to_regex("A") + S.to_regex("N")


def test_runs_and_gaps(spark):
    own = spark.createDataFrame([(1, "AAANNNNCCA"), (2, ""), (3, "NNNN")], "entry_id long, seq string")
    assert sorted(tuple(r) for r in runs.runs(own, 3, only_n=None).collect()) == [(1, "A", 0, 3), (1, "N", 3, 4), (3, "N", 0, 4)]
    assert sorted(tuple(r) for r in runs.runs(own, 3, only_n=True).collect()) == [(1, "N", 3, 4), (3, "N", 0, 4)]


def test_bitmap_lines_are_made_in_one_order(spark):
    """Lines of sets within, across and beyond their spans, of none and of full ones, from one sort of the runs: no complement is joined to them."""
    sets = {1: {0, 1, 5}, 2: {3, 4, 19}, 3: set(range(20)), 4: {25, 26, 40}, 5: {2, 18, 19, 20, 21, 30}, 6: {20, 21}, 7: {5, 19, 21}, 8: set()}
    found = runs.islands(spark.createDataFrame([(e, p) for e, s in sets.items() for p in s], "entry_id long, pos long"))
    spans = spark.createDataFrame([(e, 20) for e in sets], "entry_id long, size int")
    lines = files.bitmap_lines(found, spans)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Window [") <= 2

    def line(s):
        out, last, now = [], 0, False
        for p in range(max(20, max(s, default=0) + 1) + 1):
            end = p == 20 and not now or p == max(20, max(s, default=0) + 1)  # the span's end cuts an unset stretch in two
            if (p in s) != now or end:
                out += [p - last] if p > last or not out and p in s else []
                last, now = p, p in s
        return f"BEGIN 20 {' '.join(map(str, out))} END"

    want = {e: line(s) for e, s in sets.items()}
    assert want[4] == "BEGIN 20 20 5 2 13 1 END" and want[1] == "BEGIN 20 0 2 3 1 14 END" and want[8] == "BEGIN 20 20 END"
    assert {r.entry_id: r.line for r in lines.collect()} == want
