"""Hard negatives, the prefix trie and the quality model against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import hard_negatives, quality, trie
from strandloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_prefix_trie"])
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


# hard negatives


def mined(rows, every, positives, negatives, low, high):
    """By definition. rows: vec_id, label, vector of whole numbers."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-dot(v, w), b, own) for b, own, w in rows if b != a)
        for s, b, own in [x for x in scored if x[2] == label][:positives]:
            fit = [(t, c) for t, c, other in scored if other != label and low * -s <= 100 * -t <= high * -s][:negatives]
            yield from ((a, b, i, c, -s, -t) for i, (t, c) in enumerate(fit, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "BATCH", 4)
    monkeypatch.setattr(hard_negatives, "ROWS_A_PIVOT", 60)
    monkeypatch.setattr(hard_negatives, "FIRST", 1.0)
    monkeypatch.setattr(hard_negatives, "GROWTH", 2.0)
    centres = [[rnd.gauss(0, 0.5) for _ in range(6)] for _ in range(5)]
    vectors = [[x + rnd.gauss(0, 0.1) for x in rnd.choice(centres)] for _ in range(400)] + [[0.5] * 6] * 60 + [[0.0] * 6] * 5
    rows = [(i * 5, v, rnd.choice([0, 0, 0, 1, 2])) for i, v in enumerate(vectors)]
    odd = [(None, [1.0] * 6, 1), (9001, None, 1), (9002, [1.0, None], 1), (9003, [float("nan")] * 6, 1), (9004, [float("inf")], 0), (9005, [0.1] * 6, None), (9000, [], 1), (9006, [0.4, 0.3], 2), (10, [0.9] * 6, 9), (9100, [0.5] * 6, 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, task string, block int")
    whole = {}
    for i, v, label in rows + odd[6:]:
        made = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        whole[i] = min(made, whole.get(i, made))
    want = sorted(mined([(i, label, v + [0] * (6 - len(v))) for i, (label, v) in whole.items()], 50, 3, 4, 30, 90))
    got = sorted(tuple(r) for r in hard_negatives.mine(df, None, 50, 3, 4, 30, 90).collect())
    assert got == want and len(want) > 200
    assert hard_negatives.mine(df.limit(0)).collect() == []
    assert hard_negatives.mine(df.where("label is null")).collect() == []


def test_annuli_leave_blocks_unread(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "ROWS_A_PIVOT", 100)
    data = np.vstack([c + rnd.normal(0, 0.02, (500, 4)) for c in np.eye(4)])
    vectors = hard_negatives.cut(spark.createDataFrame([(i, 0, [int(256 * x) for x in v]) for i, v in enumerate(data)], "vec_id long, label long, v array<int>"))
    index = hard_negatives.Index(vectors)
    read = []
    monkeypatch.setattr(hard_negatives.Index, "_read", (lambda f: lambda self, *a: (lambda out: (read.append(out.count()), out)[1])(f(self, *a)))(hard_negatives.Index._read))
    none = F.lit(None).cast("long")
    tasks = hard_negatives.cut(index.keyed.where("vec_id = 700").select(F.lit(1).cast("long").alias("task"), F.col("vec_id").alias("anchor"), "label", "v", none.alias("low"), none.alias("high")))
    got = [(r.vec_id, r.score) for r in index.nearest(tasks, 5, True).orderBy("rank").collect()]
    m = np.array([[int(256 * x) for x in v] for v in data])
    scores = m @ m[700]
    assert got == [(int(i), int(scores[i])) for i in sorted(range(2000), key=lambda i: (-scores[i], i)) if i != 700][:5]
    assert sum(read) < index.blocks.count() * 5 / 2  # five rows a block that was read


# the trie


def built(rows):
    """conv_id to its rebuilt turns."""
    of = {}
    for c, turn, role, text in rows:
        if c is not None:
            of.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    of = {c: [x[2:] for x in sorted(v)] for c, v in of.items()}
    out = {}
    for c in of:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = of.get(c - int(math.fmod(c, 20)), [])[:h] + of[c][h:]
    return out


def nodes(of):
    members = {}
    for c, turns in of.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(1 for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(own) if len(of[c]) == len(node))
        yield min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(trie, "BLOCK", 3)
    says = [("user", "a b"), ("user", " one two\tthree "), (None, "x"), ("assistant", None), ("user", ""), ("assistant", "long " * 50)]
    rows = []
    for c in [*range(0, 90), -3, -20, 1000]:
        if rnd.random() < 0.8:
            n = rnd.choice([1, 1, 2, 3, 4, 5, 9])
            rows += [(c, None if rnd.random() < 0.1 else t, *rnd.choice(says[: rnd.choice([1, 2, 6])])) for t in range(n)]
    rows += [(200, t, "user", "same") for t in range(70)] + [(220 + k, t, "user", "same") for k in range(20) for t in range(40)] + [(None, 1, "user", "x"), (5, 1, "user", "a b"), (5, 1, "user", "a b")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "y", 0) for r in rows], "conv_id long, turn long, role string, text string, words string, p1 long")
    out = trie.trie(df).collect()
    got = sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out), key=repr)
    assert got == sorted(nodes(built(rows)), key=repr)
    # intervals: subtrees nest, and one holds as many nodes as its positions say
    assert sorted(r.pos for r in out) == list(range(len(out)))
    for r in out:
        inside = [x for x in out if r.pos <= x.pos <= r.end_pos]
        assert sum(x.n_children == 0 for x in inside) == r.n_leaves and all(x.end_pos <= r.end_pos for x in inside)
        assert sum(x.depth == r.depth + 1 for x in inside) == r.n_children


def test_trie_of_little(spark):
    df = spark.createDataFrame([(7, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert trie.trie(df.limit(0)).collect() == []
    assert trie.trie(df.select(F.lit(None).cast("long").alias("conv_id"), "turn", "role", "text")).collect() == []
    for c in (7, 20, 23):  # 23: no base, and its one turn may be among those left out
        one = [(c, 1, "user", "a")]
        got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.trie(spark.createDataFrame(one, df.schema)).collect()]
        assert sorted(got, key=repr) == sorted(nodes(built(one)), key=repr)


# the quality model


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels.where("quality is not null"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} and len(held) > 50
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted for r in held if r.quality) == sum(r.quality for r in held)
    assert sum(1 - r.predicted for r in held if not r.quality) >= 0.85 * sum(1 - r.quality for r in held)
    table = quality.terms(spark, model)
    assert table.where("second is null").select("feature").distinct().count() == len(quality.FEATURES) and table.where("second is not null").count() == len(model.pairs) * quality.COARSE**2


def test_quality_learns_interactions():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    model = quality.fit(x, y)
    fresh = rnd.normal(size=(1000, 4))
    right = (model.score(fresh) > 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 2] > 0))
    assert right.mean() > 0.9 and model.pairs[0][:2] == (0, 2)
    alone = quality.fit(x, y, n_pairs=0)
    assert ((alone.score(fresh) > 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 2] > 0))).mean() < 0.7


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string, x string, label int"
    texts = [None, "", " \n", "word", "ab " * 60_000, "퟿\n\n", "!!", "😀 a"]
    docs = spark.createDataFrame([(*r, "c", 5) for r in itertools.chain(enumerate(texts), [(None, "a"), (3, "word")])], schema)
    labels = spark.createDataFrame([(0, 1), (1, None), (3, 0), (3, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.score(docs, quality.train(docs, known)).collect()
        assert len(rows) == 10 and all(0 < r.score < 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 3}) == 1 and len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert quality.score(docs.limit(0), quality.Model()).collect() == []
