"""Running totals over ordered tables."""

import random

import pytest

from strandloom.plans import scans


@pytest.mark.parametrize("keyed", [True, False])
def test_running_totals(spark, keyed):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, 2, 2, 2, 3, -5]), i, rnd.randrange(-1000, 1000), rnd.getrandbits(63)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, a long, x long").repartition(7)
    got = scans.running(df, ["k", "i"], ["k", "i"], ("a",), ("x",), key="k" if keyed else None).collect()
    sums, xors, want = {}, {}, set()
    for k, i, a, x in sorted(rows):
        of = k if keyed else 0
        sums[of], xors[of] = sums.get(of, 0) + a, xors.get(of, 0) ^ x
        want.add((k, i, sums[of], xors[of]))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert scans.running(df.limit(0), ["k", "i"], ["k"], ("a",)).collect() == []
