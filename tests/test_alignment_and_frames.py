"""Alignments by built-in functions against ``align.align``, and peptides in six frames against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import align, frames, match, programs
from strandloom.plans import chooser


def back(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def varied(rnd, word, n, letters="ACGT"):
    w = list(word)
    for _ in range(n):
        kind, i = rnd.choice("sid"), rnd.randrange(len(w))
        if kind == "s":
            w[i] = rnd.choice(letters)
        elif kind == "i":
            w.insert(i, rnd.choice(letters))
        elif len(w) > 1:
            del w[i]
    return "".join(w)


@pytest.mark.parametrize("options", [{}, {"wildcards": True}, {"wildcards": True, "text_n": True}, {"indels": False}, {"left": 2, "right": 3}, {"mutations": True, "k": 3}, {"mutations": True, "indels": False, "k": 2}], ids=str)
def test_alignments_by_built_in_functions(spark, options):
    rnd = random.Random(str(options))
    options = dict(options)
    k, letters = options.pop("k", 2), "ACDEFGHIKLMNPQRSTVWYX" if "mutations" in options else "ACGT"
    rows = []
    for _ in range(150):
        pattern = "".join(rnd.choice(letters + ("NRYW" if "wildcards" in options else "")) for _ in range(rnd.choice([4, 6, 9, 14])))
        plain = "".join(rnd.choice(sorted(S.stands_for(c)) or [c]) if "wildcards" in options else c for c in pattern)
        seq = "".join(rnd.choice(letters + "N") for _ in range(rnd.randrange(6))) + varied(rnd, plain, rnd.randrange(k + 2)) + "".join(rnd.choice(letters) for _ in range(rnd.randrange(5)))
        last = rnd.randrange(max(len(seq) - 5, 0), len(seq) + 1)
        first = max(0, last - rnd.randrange(4))
        rows.append((seq, pattern, first, last, seq[max(0, first - len(pattern) - k) : last]))
    rows += [("", "ACG", 0, 0, ""), ("ACG", "ACG", 3, 3, "ACG"), ("AACG", "ACG", 4, 4, "AACG")]
    df = spark.createDataFrame(rows, "seq string, p string, first int, last int, text string").repartition(3)
    got = df.select("*", align.aligned("text", "p", "first", "last", k, **options).alias("a")).collect()
    found = 0
    for r in got:
        want = align.align(r.seq, r.p, r.first, r.last, k, **options)
        found += want is not None
        assert (tuple(r.a) if r.a else None) == want, r
    assert found > 20 or options.get("indels") is False


def near_ends(seq, pattern, k):
    """Least edits of any stretch by its end."""
    row = [0] * (len(seq) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(seq):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return {e: d for e, d in enumerate(row) if d <= k}


def test_clusters_take_their_text_along(spark):
    rnd = random.Random(9)
    patterns = {1: "ACGTTGCAAT", 2: "GGGGGGGG", 3: "TTAGGCAT"}
    texts = {i: "".join(rnd.choice("ACGT") for _ in range(40)) + varied(rnd, patterns[rnd.choice([1, 3])], 1) + "G" * rnd.choice([0, 8, 30]) + "".join(rnd.choice("ACGT") for _ in range(30)) for i in range(12)}
    texts |= {90: "", 91: "ACGTTGCAAT", 92: "CGTTGCAAT", 93: "G" * 300}
    sequences = spark.createDataFrame(list(texts.items()), "entry_id long, seq string")
    table = spark.createDataFrame(list(patterns.items()), "pattern_id long, pattern string")
    hits = chooser.find(sequences, table, k=1)
    got = {(r.entry_id, r.pattern_id, r.first_end, r.last_end, r.edits, r.text) for r in hits.select("entry_id", "pattern_id", "first_end", "last_end", "edits", "text").collect()}
    want = set()
    for e, t in texts.items():
        for i, p in patterns.items():
            ends = near_ends(t, p, 1)
            cluster = []
            for x in [*sorted(ends), None]:
                if cluster and (x is None or x - cluster[-1] > 3):
                    want.add((e, i, cluster[0], cluster[-1], min(ends[c] for c in cluster), t[max(0, cluster[0] - len(p) - 1) : cluster[-1]]))
                    cluster = []
                cluster.append(x)
    assert got == want and len(want) > 12


def test_primer_match_with_edits(spark):
    rnd = random.Random(4)
    primers = {1: "AGAAGCGAGTTCT", 2: "TTGGCTGCTGCCCC"}
    texts = {i: "".join(rnd.choice("ACGT") for _ in range(30)) + varied(rnd, rnd.choice([p, back(p)]), rnd.randrange(3)) + "".join(rnd.choice("ACGT") for _ in range(30)) for i, p in zip(range(40), [*primers.values()] * 20)}
    sequences = spark.createDataFrame(list(texts.items()), "entry_id long, seq string")
    table = spark.createDataFrame(list(primers.items()), "pattern_id long, pattern string")
    rows = programs.primer_match(sequences, table, 2, indels=True).collect()
    assert len(rows) > 25 and {r.strand for r in rows} == {"F", "R"}
    for r in rows:
        strands = primers[r.base_id] if r.strand == "F" else back(primers[r.base_id])
        assert r.pattern_gaps.replace("-", "") == strands == r.pattern and r.text_gaps.replace("-", "") == r.text == texts[r.entry_id][r.start : r.end]
        assert r.edits == r.n_sub + r.n_missing + r.n_extra and (r.n_missing, r.n_extra) == (r.ops.count("v"), r.ops.count("^"))
        assert (r.five, r.three) == ((r.start, r.end) if r.strand == "F" else (r.end, r.start))
        ends = near_ends(texts[r.entry_id], r.pattern, 2)
        assert ends[r.end] == r.edits
    assert any(r.n_missing for r in rows) and any(r.n_extra for r in rows)


CODE = {a + b + c: S.CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def in_frames(texts, peptides, k, context):
    for e, seq in texts.items():
        n = len(seq)
        for frame in range(6):
            strand = (back(seq) if frame >= 3 else seq)[frame % 3 :]
            codons = [strand[i : i + 3] for i in range(0, len(strand) - 2, 3)]
            aa = "".join(CODE.get(c, "X") for c in codons)
            for i, p in peptides.items():
                for at in range(len(aa) - len(p) + 1):
                    cost = sum(S.codon_amino_distance(c, x) if c in CODE and x in S.CODE else 3 for c, x in zip(codons[at : at + len(p)], p)) if k else 0
                    text = aa[at : at + len(p)]
                    edits = sum(a != b for a, b in zip(text, p))
                    if edits <= k and cost <= k:
                        off = at * 3 + frame % 3
                        start = n - off - 3 * len(p) if frame >= 3 else off
                        sides = [aa[max(0, at - context) : at], aa[at + len(p) : at + len(p) + context]]
                        sides = [sides[0] if at >= context else "-" + sides[0], sides[1] if len(sides[1]) == context else sides[1] + "-"]
                        yield e, i, frame, at, start, start + 3 * len(p), text, edits, cost, *(sides if context else ("", ""))


@pytest.mark.parametrize(("k", "context", "own"), [(0, 0, 64), (1, 2, 4), (2, 1, 7)])
def test_peptides_in_frames(spark, monkeypatch, k, context, own):
    monkeypatch.setattr(frames, "OWN", own)
    monkeypatch.setattr(frames, "FAR", 3 * own * 5)
    rnd = random.Random(k)
    peptides = {1: "LK", 2: "MRSW", 3: "THE*"} if k < 2 else {2: "MRSW", 4: "KTHEN"}
    texts = {i: "".join(rnd.choice("ACGT") for _ in range(rnd.choice([5, 40, 300]))) for i in range(8 if k else 40)}
    spelt = lambda p: "".join(rnd.choice([c for c, x in CODE.items() if x == a]) for a in p)
    for i in range(10, 20):
        word = spelt(rnd.choice(list(peptides.values())))
        at = rnd.randrange(len(word))
        word = word[:at] + rnd.choice("ACGT") + word[at + 1 :]
        texts[i + 50] = "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(70))) + rnd.choice([word, back(word)]) + "N" * rnd.randrange(2) + "ACGTA"
    texts |= {100: "", 101: "AC", 102: spelt(peptides[2]), 103: "NNN" + spelt(peptides[2])}
    sequences = spark.createDataFrame(list(texts.items()), "entry_id long, seq string").repartition(3)
    table = spark.createDataFrame(list(peptides.items()), "pattern_id long, pattern string")
    rows = frames.peptides_in_frames(sequences, table, k, context).select("entry_id", "pattern_id", "frame", "aa_start", "dna_start", "dna_end", "text", "edits", "cost", "left_context", "right_context").collect()
    want = sorted(in_frames(texts, peptides, k, context))
    assert sorted(map(tuple, rows)) == want and len(want) >= 12 and {r.frame for r in rows} == set(range(6))


def test_codon_letters(spark):
    rows = spark.createDataFrame([("ACGTTGCAN",), ("",), ("AC",), ("acgu",)], "s string").select("s", frames.codon_strings("s").alias("c")).collect()
    texts = {r.s: spark.createDataFrame([(x,) for x in r.c], "x string").select(frames.amino_acids("x").alias("a"), frames.amino_acids(frames.turned("x")).alias("b")).collect() for r in rows if r.s}
    assert [(r.a, r.b) for r in texts["ACGTTGCAN"]] == [("TLX", "XQR"), ("RC", "AT"), ("VA", "CN")]
    assert texts["acgu"][0].a == "T" and texts["acgu"][1].a == "R" and [r.a for r in texts["AC"]] == ["", "", ""]
    assert match.BEYOND not in frames.CODONS and len(set(frames.CODONS)) == 64
    assert spark.range(1).select(frames.codon_cost(F.lit(frames.CODONS[0] + frames.UNKNOWN), F.lit("LX")).alias("n")).first().n == 1 + 3
