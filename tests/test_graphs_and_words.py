"""Tours, forests, gap bitmaps and near words against brute force."""

import itertools
import random
from collections import Counter

import pytest

from strandloom.operators import graph, kmers, repair, uniq


def back(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def check_tours(edges, rows):
    """edges: (src, dst, label, n)."""
    copies = Counter({(a, b, x): n for a, b, x, n in edges})
    assert Counter((r.src, r.dst, r.label) for r in rows if r.label is not None) == copies
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, *_ in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    degree = Counter()
    for a, b, _, n in edges:
        degree[a] += n
        degree[b] -= n
    for component in {root(x) for x in list(up)}:
        path = sorted((r.step, r.src, r.dst) for r in rows if r.component == component)
        assert [p[0] for p in path] == list(range(len(path)))
        assert all(a[2] == b[1] for a, b in itertools.pairwise(path))
        units = sum(max(degree[x], 0) for x in up if root(x) == component)
        restarts = sum(r.label is None for r in rows if r.component == component)
        assert restarts == max(units - 1, 0) and (units or path[-1][2] == path[0][1])


@pytest.mark.parametrize("seed", range(4))
def test_tours(spark, seed):
    rnd = random.Random(seed)
    edges, at = [], 0
    for size in (1, 2, 5, 30) if seed else (4,):
        nodes = range(at, at + size)
        at += size
        seen = set()
        for _ in range(3 * size):
            a, b, x = rnd.choice(nodes), rnd.choice(nodes), rnd.choice("xyz")
            if (a, b, x) not in seen:
                seen.add((a, b, x))
                edges.append((a, b, x, rnd.choice([1, 1, 1, 2, 5])))
    if seed == 3:  # many cycles that meet in one node
        edges += [e for i in range(at, at + 40) for e in ((at + 100, i, "o", 1), (i, at + 100, "i", 1))]
    df = spark.createDataFrame(edges, "src long, dst long, label string, n long")
    check_tours(edges, graph.euler_tours(df, in_one_task=[0, 10, 1 << 20, 0][seed]).collect())


@pytest.mark.parametrize("planned", [0, 1 << 14])
def test_tours_of_many_copies(spark, monkeypatch, planned):
    """Large components by joins, and by plans whose stretches are laid out in several blocks."""
    monkeypatch.setattr(graph, "LAID_AT_ONCE", 8)
    rnd = random.Random(9)
    counts = {}
    for _ in range(60):  # closed walks and an open one, taken several times
        at = rnd.randrange(12)
        walk = [at, *(rnd.randrange(12) for _ in range(rnd.randrange(6))), at]
        n = rnd.choice([1, 3, 40])
        for a, b in itertools.pairwise(walk):
            counts[a, b, "x"] = counts.get((a, b, "x"), 0) + n
    edges = [(*e, n) for e, n in counts.items()] + [(3, 50, "y", 2), (70, 71, "z", 9), (71, 70, "z", 9), (90, 90, "o", 7)]
    rows = graph.euler_tours(spark.createDataFrame(edges, "src long, dst long, label string, n long"), in_one_task=0, planned=planned).collect()
    check_tours(edges, rows)


def test_plan_grows_with_different_edges():
    million = 10**6
    edges = [(0, 1, million), (1, 2, million), (2, 0, million), (1, 1, 5 * million), (2, 3, 1), (3, 4, 2 * million), (4, 3, 2 * million)]
    plan = graph.planned_tour(edges)
    assert sum(len(way) * laps for way, laps in plan) == sum(n for *_, n in edges) and sum(len(way) for way, _ in plan) < 30
    at, taken = 2, Counter()  # the node with a way out too many
    for way, laps in plan:
        for e in way:
            assert edges[e][0] == at
            at = edges[e][1]
            taken[e] += laps
        assert laps == 1 or edges[way[0]][0] == at
    assert [taken[i] for i in range(len(edges))] == [n for *_, n in edges]


def test_tours_of_nothing(spark):
    assert graph.euler_tours(spark.createDataFrame([], "src long, dst long, label string, n long")).collect() == []


def test_spanning_forest(spark):
    rnd = random.Random(2)
    pairs = {(rnd.randrange(40), 100 + rnd.randrange(30)) for _ in range(80)}
    tree = {tuple(r) for r in graph.spanning_forest(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}

    def parts(edges):
        up = {x: x for p in pairs for x in p}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[root(a)] = root(b)
        return len({root(x) for x in up})

    assert tree <= pairs and parts(tree) == parts(pairs) == len({x for p in pairs for x in p}) - len(tree)


def test_list_ranks(spark):
    nexts = [(i, i + 1 if i % 10 != 9 else None) for i in range(35)]
    nexts[-1] = (34, None)
    got = {r.id: (r.last, r.left) for r in graph.list_ranks(spark.createDataFrame(nexts, "id long, next long")).collect()}
    ends = [9, 19, 29, 34]
    assert got == {i: (ends[i // 10], ends[i // 10] - i) for i in range(35)}


@pytest.mark.parametrize(("m", "most", "at_once"), [(1, 5, 1 << 24), (2, 150, 1 << 24), (3, 40, 4096 * 7)])
def test_pairs_by_gap(spark, monkeypatch, m, most, at_once):
    monkeypatch.setattr(kmers, "_CODES", at_once)
    rnd = random.Random(m)
    texts = ["".join(rnd.choice("ACGTN" if rnd.random() < 0.1 else "ACGT") for _ in range(rnd.choice([0, 1, 3, 30, 200]))) for _ in range(12)] + ["ACGT" * 1500]
    sequences = spark.createDataFrame(list(enumerate(texts)), "entry_id long, seq string").repartition(4)
    want = {}
    for gap in range(most + 1):
        found = Counter()
        for t in texts:
            for i in range(len(t) - 2 * m - gap + 1):
                a, b = t[i : i + m], t[i + m + gap : i + 2 * m + gap]
                if not set(a + b) - set("ACGT"):
                    found[a, b] += 1
                    found[back(b), back(a)] += 1
        if found:
            want[gap] = (sum(n == 1 for n in found.values()), sum(n > 1 for n in found.values()), 16**m - len(found))
    got = {r.gap: (r.once, r.again, r.unseen) for r in kmers.seen_by_gap(sequences, m, most).collect()}
    assert got == want and len(want) == most + 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("options", [{"k": 0}, {"k": 1}, {"k": 2}, {"k": 1, "both_strands": True}, {"k": 1, "edits": True}, {"k": 1, "inexact_only": True}, {"k": 2, "left": 3, "right": 2}, {"k": 1, "left": 5, "right": 4}], ids=str)
@pytest.mark.parametrize("same", [True, False])
def test_matched_elsewhere(spark, options, same):
    m = 9
    rnd = random.Random(str(options))
    letters = "ACGT"
    core = ["".join(rnd.choice(letters) for _ in range(14)) for _ in range(4)]

    def changed(w):
        w = list(w)
        for _ in range(rnd.randrange(3)):
            i = rnd.randrange(len(w))
            w[i : i + 1] = rnd.choice([[rnd.choice(letters)], [], [w[i], rnd.choice(letters)]]) if options.get("edits") else [rnd.choice(letters)]
        return "".join(w)

    make = lambda: "".join(rnd.choice(letters) for _ in range(10)) + rnd.choice([lambda x: x, back])(changed(rnd.choice(core))) + rnd.choice(["", "N", "A" * 12])
    queries = {i: make() for i in range(10)} | {50: "", 51: "ACGT", 52: core[0] + core[0][:9]}
    others = queries if same else {i: make() for i in range(100, 108)}
    q, b = (spark.createDataFrame(list(x.items()), "entry_id long, seq string") for x in (queries, others))
    got = {tuple(r) for r in uniq.matched_elsewhere(q, q if same else b, m, same=same, **options).collect()}
    k, left, right = options["k"], options.get("left", 0), options.get("right", 0)
    words = lambda texts, n: [(e, i, t[i : i + n]) for e, t in texts.items() for i in range(len(t) - n + 1) if not set(t[i : i + n]) - set(letters)]
    back_words = [x for n in ((m - 1, m, m + 1) if options.get("edits") else (m,)) for x in words(others, n)]
    if options.get("both_strands"):
        back_words += [(e, i, back(w)) for e, i, w in back_words]

    def near(a, b):
        if options.get("edits"):
            return edit_distance(a, b) <= 1
        return sum(x != y for x, y in zip(a, b)) <= k and a[:left] == b[:left] and a[m - right :] == b[m - right :]

    want = {(e, i) for e, i, w in words(queries, m) if any(near(w, v) and not (same and e == f and abs(i - j) < m) and not (options.get("inexact_only") and v == w) for f, j, v in back_words)}
    assert got == want and want


def test_unitigs_keep_cycles(spark):
    edges = [(1, 2, "a", 3), (2, 3, "b", 2), (3, 4, "c", 5), (7, 8, "d", 1), (8, 9, "e", 4), (9, 7, "f", 6), (4, 1, "g", 9), (4, 5, "h", 1), (11, 11, "i", 2), (20, 21, "x", 1), (21, 20, "y", 1)]
    df = spark.createDataFrame(edges, "src long, dst long, label string, n long")
    got = {(r.head, r.tail, r.label, r.n) for r in graph.unitigs(df, whole=True).collect()}
    assert got == {(4, 4, "gabc", 2), (4, 5, "h", 1), (7, 7, "def", 1), (11, 11, "i", 2), (20, 20, "xy", 1)}


def test_threads_of_reads(spark):
    rnd = random.Random(6)
    m = 4
    texts = ["".join(rnd.choice("ACGT") for _ in range(90)) for _ in range(6)]
    texts += [texts[0][10:70] + texts[1][20:80], texts[2][:50] + texts[0][30:]]
    sequences = spark.createDataFrame(list(enumerate(texts)), "entry_id long, seq string")
    edges = graph.word_graph(graph.x_spaces(sequences, m), sequences, m).select("src", "dst", "label", "n").cache()
    table = edges.collect()
    assert len({len(e.label) for e in table}) > 2
    reads = {i: t[rnd.randrange(20) :][: rnd.randrange(20, 70)] for i, t in enumerate(texts)} | {50: texts[3][:30] + "N" + texts[3][31:], 51: "", 52: "ACG"}
    rows = graph.threaded(spark.createDataFrame(list(reads.items()), "entry_id long, seq string"), edges, m).collect()
    # by definition: every maximal run of words of a read along an edge, and their links
    want = set()
    for e, t in reads.items():
        for x in table:
            path = x.src + x.label
            for start in range(-len(x.label) + 1, len(t) - m):
                at = [o for o in range(len(x.label)) if 0 <= start + o <= len(t) - m - 1 and t[start + o : start + o + m + 1] == path[o : o + m + 1]]
                for o in at:
                    if o - 1 not in at:
                        last = o
                        while last + 1 in at:
                            last += 1
                        want.add((e, x.src, x.dst, x.label, start, o, last))
    assert {(r.entry_id, r.src, r.dst, r.label, r.start, r.first, r.last) for r in rows} == want and len(want) == len(rows) > 30
    threads = {}
    for r in rows:
        threads.setdefault((r.entry_id, r.thread), []).append(r)
    for own in threads.values():
        own.sort(key=lambda r: r.step)
        assert [r.step for r in own] == list(range(len(own)))
        for a, b in itertools.pairwise(own):
            assert a.dst == b.src and a.start + len(a.label) == b.start and a.last == len(a.label) - 1 and b.first == 0
    assert max(map(len, threads.values())) > 3
    counts = {(r.entry_id, r.pos): r.n for r in graph.path_counts(spark.createDataFrame(list(reads.items()), "entry_id long, seq string"), edges, m).collect()}
    along = Counter()
    for x in table:
        path = x.src + x.label
        for o in range(len(x.label)):
            along[path[o : o + m + 1]] += x.n
    assert counts == {(e, i): along[t[i : i + m + 1]] for e, t in reads.items() for i in range(len(t) - m)}


def test_assembly_through_repeats(spark):
    """Two repeats, each with its own surroundings twice: reads that span them tell the two genomes apart."""
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    repeats = [word(14), word(16)]
    genomes = [word(30) + repeats[0] + word(25) + repeats[1] + word(30) for _ in range(2)]
    reads = [g[i : i + 40] for g in genomes for i in range(0, len(g) - 39, 3)] + genomes
    df = spark.createDataFrame(list(enumerate(reads)), "entry_id long, seq string")
    m = 8
    edges = graph.word_graph(graph.x_spaces(df, m), df, m).select("src", "dst", "label", "n")
    plain = {r.src + r.label for r in repair.contracted(edges).collect()}
    found = repair.assembled(df, m).collect()
    texts = {r.text for r in found}
    # resolved: nothing but what stands in the genomes, and through both repeats of each
    assert all(any(t in g for g in genomes) for t in texts)
    assert max(map(len, texts)) > max(map(len, plain))
    for g in genomes:
        assert any(t in g and repeats[0] in t and repeats[1] in t for t in texts)
    words_of = lambda ts: {t[i : i + m + 1] for t in ts for i in range(len(t) - m)}
    assert words_of(texts) == words_of(plain)


def test_passages_of_short_edges_are_not_sorted(spark):
    """Edges of one letter, all of the graph here, are found without an exchange of places; other letters and absent texts have no passage."""
    texts = {1: "ACGTTGCAACGTNACGTTGCA", 2: None, 3: "", 4: "TTGCAACGGACGTTGAC", 5: "\N{GREEK SMALL LETTER ALPHA}ACGTT"}
    reads = spark.createDataFrame(list(texts.items()), "entry_id long, seq string")
    edges = spark.createDataFrame([("ACG", "CGT", "T", 3), ("CGT", "GTT", "T", 2), ("TGC", "GCA", "A", 7)], "src string, dst string, label string, n long")
    got = graph.edge_passages(reads, edges, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    want = {(e, s, d, x, n, i, 0, 0) for e, t in texts.items() for s, d, x, n in edges.collect() for i in range(len(t or "")) if t.startswith(s + x, i)}
    rows = got.select("entry_id", "src", "dst", "label", "n", "start", "first", "last").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) >= 9
