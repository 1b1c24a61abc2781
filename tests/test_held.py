"""Texts that stand in others, found where they are read: by brute force, and without places, candidates or texts that are exchanged."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom import catalog
from strandloom.operators import held, uniq

SF = "/root/testdata/sf0.001"
SIZES = [1, 2, 3, 5, 8, 16, 31, 32, 33, 40, 63, 64, 65, 100, 128, 200]


def drawn(seed, letters="ABC"):
    """Stretches of a text of all sizes around the powers of two, texts that share a beginning, copies, and one with other letters."""
    draw = random.Random(seed)
    long = "".join(draw.choice(letters) for _ in range(400))
    cut = [long[a : a + n] for n in SIZES for a in (0, draw.randrange(300), 400 - n)]
    return [*cut, long, long, "XY" + long, long[:100] + "X", long[:100] + "Y" + long, "é" + long[:70], "X" * 40, "X" * 64, "X" * 39 + "Y", "", ""]


def pairs(texts, least=1):
    return sorted((a, b) for a, s in enumerate(texts, 1) for b, w in enumerate(texts, 1) if least <= len(s) < len(w) and s in w)


@pytest.mark.parametrize("skip_short", [False, True])
@pytest.mark.parametrize("at_once", [1 << 20, 11])
def test_containment_without_joins_of_places(spark, monkeypatch, skip_short, at_once):
    monkeypatch.setattr(uniq, "FEW_LETTERS", 0)
    monkeypatch.setattr(held, "PARTS", at_once)  # all texts are read for eleven parts at a time
    texts = drawn(5)
    df = uniq.contained(spark.createDataFrame(list(enumerate(texts, 1)), "entry_id long, seq string"), skip_short=skip_short)
    assert sorted(map(tuple, df.select("part", "whole").collect())) == pairs(texts, 6 if skip_short else 1)


def test_non_redundant_with_containment(spark):
    texts = drawn(6)
    got = sorted(map(tuple, uniq.non_redundant_with_containment(spark.createDataFrame(list(enumerate(texts, 1)), "entry_id long, seq string")).select("entry_id", "seq", "n").collect()))
    kept = {s for s in texts if not s or not any(len(s) < len(w) and s in w for w in texts)}
    assert got == sorted((texts.index(s) + 1, s, sum(bool(x) and x in s for x in texts) if s else 2) for s in kept) and len(got) > 4


def test_what_is_exchanged(spark, monkeypatch):
    """Neither a row a place nor a row a candidate leaves the task that reads a text."""
    monkeypatch.setattr(uniq, "FEW_LETTERS", 0)
    for name in ("j20_containment", "f14_short_seeds_skipped", "t4_non_redundant_with_containment"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "explode(" not in plan and "(mer" not in plan and "(level" not in plan


@pytest.mark.parametrize(("letters", "at_once", "chain"), [(10, 7, 0), (300, 64, 2), (300, 7, 3), (1 << 20, 1 << 16, 5)])
def test_stretches_by_sums(monkeypatch, letters, at_once, chain):
    """Blocks, rounds and chains of all sizes find the same, each place a true one."""
    for name, x in (("LETTERS", letters), ("AT_ONCE", at_once), ("CHAIN", chain)):
        monkeypatch.setattr(held, name, x)
    texts = sorted(set(drawn(7, "AB")) - {""})
    powers, rows = held._Powers(), []
    for low, high in held._blocks(texts):
        sums = held._Sums(texts[low:high], powers)
        for t, end in zip(texts[low:high], sums.ends.tolist()):
            at = end - len(t)
            begins = [int(sums.at(np.array([at]), 1 << j).view(np.int64)[0]) for j in held._levels(len(t))]
            rows.append((hashlib.md5(t.encode()).digest(), len(t), int(sums.at(np.array([at]), len(t)).view(np.int64)[0]), begins))
    kinds = {"key": pa.binary(), "n": pa.int64(), "whole_hash": pa.int64(), "begins": pa.list_(pa.int64())}
    known = held._Known(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())}))
    text_of, found = {hashlib.md5(t.encode()).digest(): t for t in texts}, set()
    for low, high in held._blocks(texts):
        sums = held._Sums(texts[low:high], powers)
        for row, place, part in held._found(sums, known):
            for r, p, k in zip(row.tolist(), place.tolist(), part.tolist()):
                whole, own = texts[low + r], text_of[known.keys[k].tobytes()]
                assert whole[p - (int(sums.ends[r]) - len(whole)) :].startswith(own)
                found.add((own, whole))
    assert found == {(a, b) for a in texts for b in texts if len(a) < len(b) and a in b}
