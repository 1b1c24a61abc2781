"""Masses of stretches by brute force."""

import random

from strandloom.functions import seq as S
from strandloom.operators import mass


def test_stretches_by_brute_force(spark):
    seqs = {1: "GASPVKR" * 40, 2: "MX!GAéGA", 3: "", 4: None, 5: "W"}
    low, high = 128.0, 260.0
    want = []
    for entry, seq in seqs.items():
        for i in range(len(seq or "")):
            for n in range(1, min(int(high / 50), len(seq) - i) + 1):
                piece = seq[i : i + n]
                if all(c in S.MONO for c in piece) and low <= sum(S.MONO[c] for c in piece) <= high:
                    want.append((entry, i, n))
    table = spark.createDataFrame(list(seqs.items()), "entry_id bigint, seq string")
    got = mass.substring_masses(table, low, high)
    assert sorted((r.entry_id, r.start, r.length) for r in got.collect()) == sorted(want)
    assert mass.substring_masses(table.where("false"), low, high).count() == 0


def test_multiplicity_lists_no_pairs(spark):
    """Counts of masses near queries, at the very border too, equal the pairs counted; queries that are equal, absent or far come out as well."""
    rnd = random.Random(4)
    masses = [round(rnd.uniform(99, 103), 2) for _ in range(400)] + [100.1, 100.0 + 0.1, 99.9, 100.0 - 0.1, None]
    asked = [(i, round(rnd.uniform(98, 104), 1)) for i in range(60)] + [(60, 100.0), (61, 100.0), (62, None), (63, 5000.0), (64, float("nan"))]
    queries = spark.createDataFrame(asked, "query long, mw double")
    index = spark.createDataFrame([(m,) for m in masses], "mass double")
    got = mass.multiplicity(queries, index, 0.1)
    assert "Join [bin" not in got._jdf.queryExecution().executedPlan().toString()
    want = {q: sum(m is not None and mw is not None and abs(mw - m) <= 0.1 for m in masses) for q, mw in asked}
    rows = got.collect()
    assert {r.query: r.n for r in rows} == want and len(rows) == len(asked) and max(want.values()) > 9


def test_different_peptides(spark):
    """The peptides of the digest; those out of the queries' reach may be left out."""
    rnd = random.Random(6)
    texts = ["", None, "K", "MK", "MKP", "MAKRPKM"] + ["M" * (i % 2) + "".join(rnd.choice("AKRPGMOW") for _ in range(60)) for i in range(20)]
    own = spark.createDataFrame(list(enumerate(texts)), "entry_id long, seq string")
    queries = spark.createDataFrame([(1, 300.0), (2, 420.5)], "query long, mw double")
    for missed, met in ((0, True), (1, True), (2, True), (1, False)):
        rows = mass.different_peptides(own, missed, met).collect()
        want = {r.peptide for r in mass.digest(own, missed, met).select("peptide").collect()}
        assert {r.peptide for r in rows} == want and len(rows) == len(want) > 50
    weigh = lambda p: sum(S.MONO[c] for c in p) if all(c in S.MONO for c in p) else None
    near = lambda ps: {p for p in ps if (w := weigh(p)) is not None and 299.9 <= w <= 420.6}
    kept = {r.peptide for r in mass.different_peptides(own, only=mass.in_reach(queries, 0.1)).collect()}
    whole = {r.peptide for r in mass.different_peptides(own).collect()}
    assert near(kept) == near(whole) != set() and len(kept) < len(whole)
