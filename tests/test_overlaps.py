"""Nearest overlaps against all pairs tried one by one; scalar functions that read a text once."""

import random

from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import graph


def overlap(x, y, shortest, longest):
    return max((n for n in range(shortest, min(longest, len(x), len(y)) + 1) if x[-n:] == y[:n]), default=None)


def nearest(left, right, shortest, longest, most):
    out = set()
    for a, x in left:
        found = {}
        for b, y in right:
            n = overlap(x, y, shortest, longest) if x and y and a != b else None
            if n:
                found[b] = max(n, found.get(b, 0))
        out |= {(a, b, n) for b, n in sorted(found.items(), key=lambda t: (-t[1], t[0]))[:most]}
    return out


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} bigint, seq string")


def test_nearest_overlaps(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("AC", k=r.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, "ACACACACAC") for i in range(30)] + [(200, None), (201, ""), (202, "A")]  # many equal texts, each its own partner
    for most in (1, 3, 11):
        got = [tuple(x) for x in graph.nearest_overlaps(table(spark, rows, "a"), table(spark, rows, "b"), 2, 8, most).collect()]
        assert set(got) == nearest(rows, rows, 2, 8, most) and len(got) == len(set(got))


def test_nearest_overlaps_of_empty_and_repeated_rows(spark):
    rows = [(1, "TTAC"), (2, "ACGG")]
    assert graph.nearest_overlaps(table(spark, [], "a"), table(spark, rows, "b"), 2, 4, 2).count() == 0
    assert graph.nearest_overlaps(table(spark, rows, "a"), table(spark, [], "b"), 2, 4, 2).count() == 0
    assert [tuple(x) for x in graph.nearest_overlaps(table(spark, rows * 2, "a"), table(spark, rows * 9, "b"), 2, 4, 1).collect()] == [(1, 2, 2)]


def test_jumpers_cost(spark):
    found = graph.jumpers(table(spark, [(1, "TTACG")], "a"), table(spark, [(2, "ACGTT"), (3, "CGAAA"), (4, "GGGGG")], "b"), 6, 2, 1)
    assert [tuple(x) for x in found.select("a", "b", "overlap", "cost").collect()] == [(1, 2, 3, 2)]


def test_plan_keeps_few_before_the_exchange(spark):
    rows = table(spark, [(1, "TTAC"), (2, "ACGG")], "a")
    plan = graph.nearest_overlaps(rows, rows.withColumnRenamed("a", "b"), 2, 4, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_functions_of_null_empty_and_long_texts(spark):
    long = "ATGGCCTAA" * 40_000
    rows = spark.createDataFrame([(None,), ("",), ("AT",), ("ATGNNNTAA",), ("AT\nGCC",), (long,)], "seq string")
    got = [(r.p, r.c) for r in rows.select(S.translation("seq", 0).alias("p"), S.colour_space("seq").alias("c")).collect()]
    code = {"A": 0, "C": 1, "G": 2, "T": 3}

    def colours(t):
        letters = "G" + t
        return "G" + "".join(str(code.get(a, -1) ^ code.get(b, -1)) for a, b in zip(letters, letters[1:], strict=False))

    assert [p for p, _ in got] == ["", "", "", "MX*", "XA", "MA*" * 40_000]
    assert [c for _, c in got] == ["G", *(colours(t) for t in ("", "AT", "ATGNNNTAA", "AT\nGCC", long))]
    turned = rows.where(F.length("seq") == len(long)).select(S.translation("seq", 3).alias("p")).first().p
    assert turned == "LGH" * 40_000
