"""Word graphs: building, components, statistics, paths, tours and transport.

edges: src, dst, n (count), and what else the operator names. nodes: id, seq.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.lineage import cut
from ..plans.scans import parts_of, running
from .kmers import CODED, coded_words, sized, words


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that a pair (a, b) of different nodes names.

    Alternating large-star and small-star rounds: each node's larger neighbours, then its smaller ones and itself, are tied to the least
    of its neighbourhood, until nothing changes. Only minima are aggregated, so a large component is no large group.
    """
    edges = cut(pairs.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    for _ in range(rounds):
        around = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = around.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = around.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        both = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))
        edges = cut(large.join(least, "v").select(F.explode(both).alias("x")).select("x.v", "x.u").where("v != u").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % (1 << 40))).first()
        if now == before:
            heads = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(heads)
        before = now
    raise RuntimeError("components did not settle")


def _counted_windows(sequences: DataFrame, m: int) -> DataFrame:
    """l, kmer, r, n, first_entry: every different word of m letters with the letters on both sides, null beyond an end. Counted as one text each, so that equal ones are put together where they are read."""
    padded = sequences.select("entry_id", F.concat(F.lit("$"), "seq", F.lit("$")).alias("seq"))
    counted = words(padded, m + 2).groupBy("kmer").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_entry"))
    side = lambda x, name: F.when(F.expr(x) != "$", F.expr(x)).alias(name)
    return counted.select(side("left(kmer, 1)", "l"), F.expr(f"substring(kmer, 2, {m})").alias("kmer"), side("right(kmer, 1)", "r"), "n", "first_entry")


def _branching(windows: DataFrame) -> DataFrame:
    """kmer: the words of ``x_spaces``, from ``_counted_windows``."""
    sided = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), F.lit(0))
    all_of = windows.groupBy("kmer").agg(F.sum("n").alias("n"), F.min("l").alias("l0"), F.max("l").alias("l1"), F.min("r").alias("r0"), F.max("r").alias("r1"), sided("l").alias("nl"), sided("r").alias("nr"))
    return all_of.where("n > 1 and (nl < n or nr < n or l0 != l1 or r0 != r1)").select("kmer")


def branching(sequences: DataFrame, m: int) -> DataFrame:
    """kmer: the branching words of ``x_spaces``, once each."""
    return _branching(_counted_windows(sequences, m))


def x_spaces(sequences: DataFrame, m: int) -> DataFrame:
    """entry_id, pos, kmer of every occurrence of the branching words: they occur twice at least, and not all with one left and one right letter; a sequence's end is a letter of its own each time."""
    chosen = sized(branching(sequences, m), m)
    return words(sequences, m).select("entry_id", F.col("pos").cast("bigint").alias("pos"), "kmer").join(chosen, "kmer", "left_semi").select("entry_id", "pos", "kmer")


#: Letters of a label that are put together at once.
BLOCK = 1 << 10


def text_graph(sequences: DataFrame, m: int) -> DataFrame:
    """The ``word_graph`` of the ``x_spaces`` of whole sequences: src, dst, label, n, first_entry, first_pos.

    Two branching words next to each other are one word of m + 1 letters, so these edges are counted as words are, and no place is sorted or joined. Only where a branching word
    and another meet are places listed: from such a place to the next the letters are a label. Of many letters it is put together in blocks.
    """
    windows = cut(_counted_windows(sequences, m))
    chosen = cut(_branching(windows))
    pairs = windows.where("r is not null").groupBy(F.concat("kmer", "r").alias("word")).agg(F.sum("n").alias("n"), F.min("first_entry").alias("first_entry"))
    known = lambda c: chosen.select(F.col("kmer").alias(c), F.lit(True).alias(f"in_{c}"))
    pairs = pairs.select("word", F.expr(f"left(word, {m})").alias("src"), F.expr(f"right(word, {m})").alias("dst"), "n", "first_entry").join(known("src"), "src", "left").join(known("dst"), "dst", "left")
    pairs = cut(pairs.select("word", "src", "dst", "n", "first_entry", F.coalesce("in_src", F.lit(False)).alias("a"), F.coalesce("in_dst", F.lit(False)).alias("b")))

    # the first place of a word: that in its first entry, of which only the entries that are first for a word are read again
    near = pairs.where("a and b")
    again = sequences.join(sized(near.select(F.col("first_entry").alias("entry_id")).distinct(), 8), "entry_id", "left_semi")
    places = words(again, m + 1).join(sized(near.select(F.col("word").alias("kmer"), F.col("first_entry").alias("entry_id")), m + 9), ["kmer", "entry_id"])
    first = places.groupBy(F.col("kmer").alias("word")).agg(F.min("pos").cast("bigint").alias("first_pos"))
    edges = near.join(first, "word").select("src", "dst", F.expr("right(word, 1)").alias("label"), "n", "first_entry", "first_pos")

    apart = pairs.where("not (a and b)").select(F.col("word").alias("kmer"), "a", "b")
    if apart.where("a").isEmpty():
        return edges
    order = Window.partitionBy("entry_id").orderBy("pos")
    laid = words(sequences, m + 1).join(sized(apart, m + 3), "kmer").select("entry_id", F.col("pos").cast("bigint").alias("pos"), "kmer", "a", "b").withColumn("gap", F.sum(F.col("a").cast("bigint")).over(order)).where("gap > 0")
    blocks = laid.groupBy("entry_id", "gap", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.min("pos").alias("pos"), F.max(F.when(F.col("a"), F.expr(f"left(kmer, {m})"))).alias("src"), F.max(F.when(F.col("b"), F.expr(f"right(kmer, {m})"))).alias("dst"), F.array_sort(F.collect_list(F.struct("pos", F.expr("right(kmer, 1)").alias("x")))).alias("all")
    )
    blocks = blocks.select("entry_id", "gap", "pos", "src", "dst", F.array_join(F.transform("all", lambda x: x["x"]), "").alias("part"))
    gaps = blocks.groupBy("entry_id", "gap").agg(F.min("pos").alias("pos"), F.max("src").alias("src"), F.max("dst").alias("dst"), F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("all")).where("dst is not null")
    steps = gaps.select("entry_id", "pos", "src", "dst", F.array_join(F.transform("all", lambda x: x["part"]), "").alias("label"))
    least = steps.groupBy("src", "dst", "label").agg(F.count("*").alias("n"), F.min(F.struct("entry_id", "pos")).alias("first"))
    return edges.unionByName(least.select("src", "dst", "label", "n", F.col("first.entry_id").alias("first_entry"), F.col("first.pos").alias("first_pos")))


def word_graph(spaces: DataFrame, sequences: DataFrame, m: int) -> DataFrame:
    """src, dst (words), label (the letters that the step adds), n, first_entry, first_pos: neighbouring spaces of an entry are an edge; equal edges collapse."""
    order = Window.partitionBy("entry_id").orderBy("pos")
    steps = spaces.select("entry_id", "pos", F.col("kmer").alias("src"), F.lead("kmer").over(order).alias("dst"), F.lead("pos").over(order).alias("to")).where("dst is not null and `to` > pos")
    cut_out = steps.join(sequences.select("entry_id", "seq"), "entry_id").select("entry_id", "pos", "src", "dst", S.subsequence("seq", F.col("pos") + m, F.col("to") - F.col("pos")).alias("label"))
    first = F.min(F.struct("entry_id", "pos"))
    return cut_out.groupBy("src", "dst", "label").agg(F.count("*").alias("n"), first.alias("first")).select("src", "dst", "label", "n", F.col("first.entry_id").alias("first_entry"), F.col("first.pos").alias("first_pos"))


def numbered(words: DataFrame, column: str = "kmer") -> DataFrame:
    """id (from 1, by order of the words), seq. Ranges are numbered part by part: no single task sees all words."""
    own = cut(words.select(F.col(column).alias("seq")).distinct().repartitionByRange("seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in own.groupBy("part").count().collect()}  # one number a partition
    at, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, at))
        at += sizes[part]
    starts = own.sparkSession.createDataFrame(offsets, "part int, offset bigint")
    order = Window.partitionBy("part").orderBy("seq")
    return own.join(F.broadcast(starts), "part").select((F.col("offset") + F.row_number().over(order)).alias("id"), "seq")


def count_filtered(edges: DataFrame, sign: str, count: int) -> DataFrame:
    """Edges whose count is = > or < the number."""
    n = F.col("n")
    return edges.where({"=": n == count, ">": n > count, "<": n < count}[sign])


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out, surplus (out minus in) by edge multiplicity."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.col("n").alias("o")), F.struct(F.col("dst").alias("node"), F.col("n").alias("i"), F.lit(0).alias("o")))
    out = edges.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return out.withColumn("surplus", F.col("n_out") - F.col("n_in"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, multiplicity, balanced, surplus and deficit nodes and units, sources, sinks, pass-through nodes."""
    d = degrees(edges).agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("surplus") == 0).alias("n_balanced"),
        F.count_if(F.col("surplus") > 0).alias("n_surplus"),
        F.count_if(F.col("surplus") < 0).alias("n_deficit"),
        F.sum(F.greatest("surplus", F.lit(0))).alias("units"),
        F.count_if(F.col("n_in") == 0).alias("n_sources"),
        F.count_if(F.col("n_out") == 0).alias("n_sinks"),
        F.count_if((F.col("n_in") == 1) & (F.col("n_out") == 1)).alias("n_trivial"),
    )
    e = edges.agg(F.count("*").alias("n_edges"), F.sum("n").alias("multiplicity"))
    return d.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")


def ambiguous_edges(edges: DataFrame) -> DataFrame:
    """src, first, n: nodes with several out edges that begin with one letter (none: the graph is deterministic). edges: with label."""
    return edges.groupBy("src", F.substring("label", 1, 1).alias("first")).agg(F.count("*").alias("n")).where("n > 1")


def merged_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between the smallest nodes of each sequence, equal ones once."""
    to = nodes.groupBy("seq").agg(F.min("id").alias("kept")).join(nodes, "seq").select("id", "kept")
    out = edges.join(to.withColumnRenamed("id", "src"), "src").drop("src").withColumnRenamed("kept", "src")
    return out.join(to.withColumnRenamed("id", "dst"), "dst").drop("dst").withColumnRenamed("kept", "dst").dropDuplicates(["src", "dst", "label"])


def balance(edges: DataFrame, close: bool = False) -> DataFrame:
    """component, src, dst: restart edges from deficit to surplus nodes, the i-th unit of one to the i-th of the other in each component; one fewer than there are, so that a tour has two ends, unless closed. Nodes are bigint."""
    member = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    d = cut(degrees(edges).join(member, "node"))
    one = F.lit(1).cast("bigint").alias("i")

    def spread(side: Column) -> DataFrame:
        units = d.where(side > 0).select("component", "node", F.explode(F.sequence(F.lit(1).cast("bigint"), side.cast("bigint"))).alias("unit"), one)
        return running(units, ["component", "node", "unit"], ["component", "node"], ("i",), key="component").withColumnRenamed("i_to", "i")

    need, have = spread(-F.col("surplus")), spread(F.col("surplus"))
    out = need.alias("x").join(have.alias("y"), ["component", "i"]).select("component", "i", F.col("x.node").alias("src"), F.col("y.node").alias("dst"))
    if not close:
        out = out.join(have.groupBy("component").agg(F.max("i").alias("most")), "component").where("i < most").drop("most")
    return out.drop("i")


def unitigs(edges: DataFrame, rounds: int = 60, whole: bool = False) -> DataFrame:
    """head, tail, label, steps of maximal paths through nodes with one edge in and one out, by pointer doubling: each round joins every path with the path that follows it, so a chain of n edges takes log n rounds.

    Cycles of such nodes have no ends and are left out; with ``whole`` each of them is opened at its smallest node, and a column n has the least count along the path. edges: src, dst, label[, n].
    """
    ins = edges.groupBy("dst").agg(F.count("*").alias("i")).select(F.col("dst").alias("node"), "i")
    outs = edges.groupBy("src").agg(F.count("*").alias("o")).select(F.col("src").alias("node"), "o")
    inner = cut(ins.join(outs, "node").where("i = 1 and o = 1").select("node"))
    if whole:
        between = edges.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi")
        marked = edges.select(F.col("src").alias("node"), "dst").join(inner, "node").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti").select("node")
        rings = components(between.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        # a chain has a node from which it goes on to a node that is not inner; a cycle has none
        open_chains = rings.join(marked, "node").select("component").distinct()
        loops = edges.where("src = dst").select(F.col("src").alias("node"))
        opened = rings.join(open_chains, "component", "left_anti").select(F.col("component").alias("node")).unionByName(loops).distinct()
        inner = cut(inner.join(opened, "node", "left_anti"))
    marked = edges.join(inner.select(F.col("node").alias("src"), F.lit(True).alias("from_inner")), "src", "left").join(inner.select(F.col("node").alias("dst"), F.lit(True).alias("to_inner")), "dst", "left")
    n = F.col("n").cast("bigint") if whole else F.lit(1).cast("bigint")
    paths = cut(marked.select("src", "dst", "label", n.alias("n"), F.lit(1).cast("bigint").alias("steps"), F.coalesce("from_inner", F.lit(False)).alias("a"), F.coalesce("to_inner", F.lit(False)).alias("b")))
    for _ in range(rounds):
        if not paths.where("b and not a").limit(1).count():
            return paths.where("not a and not b").select(F.col("src").alias("head"), F.col("dst").alias("tail"), "label", "steps", *(["n"] if whole else []))
        nxt = paths.where("a").select(F.col("src").alias("dst"), F.col("dst").alias("dst2"), F.col("label").alias("label2"), F.col("steps").alias("steps2"), F.col("n").alias("n2"), F.col("b").alias("b2"))
        going = paths.where("b").join(nxt, "dst").select("src", F.col("dst2").alias("dst"), F.concat("label", "label2").alias("label"), F.least("n", "n2").alias("n"), (F.col("steps") + F.col("steps2")).alias("steps"), "a", F.col("b2").alias("b"))
        paths = cut(going.unionByName(paths.where("not b")))
    raise RuntimeError("paths did not settle")


def spanning_forest(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """Of the pairs (a, b), those of a spanning forest: in each round every tree takes its least pair to another tree, and trees that took one grow together. a, b: bigint."""
    every = cut(pairs.select("a", "b").distinct())
    open_pairs = every.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))  # x, y: the trees of a and b
    chosen = None
    for _ in range(rounds):
        ends = F.explode(F.array("x", "y")).alias("tree")
        taken = cut(open_pairs.select(ends, "a", "b", "x", "y").groupBy("tree").agg(F.min(F.struct("a", "b", "x", "y")).alias("e")).select("e.*").distinct())
        chosen = taken.select("a", "b") if chosen is None else chosen.unionByName(taken.select("a", "b"))
        to = components(taken.select(F.col("x").alias("a"), F.col("y").alias("b")))
        moved = open_pairs.join(to.select(F.col("node").alias("x"), F.col("component").alias("x2")), "x").join(to.select(F.col("node").alias("y"), F.col("component").alias("y2")), "y")
        open_pairs = cut(moved.where("x2 != y2").select("a", "b", F.col("x2").alias("x"), F.col("y2").alias("y")))
        if open_pairs.isEmpty():
            return chosen
    raise RuntimeError("trees did not settle")


def list_ranks(nexts: DataFrame, rounds: int = 60) -> DataFrame:
    """id, last, left: of chains given by id and next (null at the end), the end of each one's chain and how many steps it is away, by pointer doubling."""
    at = cut(nexts.select("id", F.col("next").alias("to"), F.col("id").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("left")))
    for _ in range(rounds):
        going = at.where("`to` is not null")
        if going.isEmpty():
            return at.select("id", "last", "left")
        ahead = at.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("left").alias("left2"))
        jumped = going.join(ahead, "to").select("id", F.col("to2").alias("to"), F.col("last2").alias("last"), (F.col("left") + F.col("left2")).alias("left"))
        at = cut(at.where("`to` is null").unionByName(jumped))
    raise RuntimeError("chains did not settle")


def tour(pairs: list[tuple[object, object, str]]) -> list[tuple[object, object, str]]:
    """Edges of a connected, balanced (but for two nodes at most) multigraph in the order of an Euler tour."""
    out: dict[object, list[tuple[object, str]]] = defaultdict(list)
    surplus: dict[object, int] = defaultdict(int)
    for a, b, label in sorted(pairs, key=str, reverse=True):
        out[a].append((b, label))
        surplus[a] += 1
        surplus[b] -= 1
    if not pairs:
        return []
    start = min((x for x in surplus if surplus[x] > 0), default=min((a for a, _, _ in pairs), key=str), key=str)
    stack: list[tuple[object, object, str]] = [(None, start, "")]
    found = []
    while stack:
        node = stack[-1][1]
        if out[node]:
            to, label = out[node].pop()
            stack.append((node, to, label))
        else:
            found.append(stack.pop())
    return [e for e in reversed(found) if e[0] is not None]


#: A component of up to so many edges, copies and restarts counted, is toured in one task; a larger one by a plan or by joins.
TOUR_EDGES = 1 << 21
#: A larger component of up to so many different edges is planned in one task and laid out by all; one of more is toured by joins.
PLAN_EDGES = 1 << 14
#: Steps of a tour that one row of a plan stands for, at most, before they are laid out.
LAID_AT_ONCE = 1 << 16


def planned_tour(edges: list[tuple[object, object, int]]) -> list[tuple[list[int], int]]:
    """Stretches (places of edges in the list, laps) that are, one after the other, an Euler tour of a connected multigraph, balanced but for two nodes at most. edges: src, dst, n (copies).

    The copies are not walked one by one: what is left beside a path from the one odd node to the other is taken apart into cycles, each as often as its rarest edge is left, so there are no more
    cycles than different edges. A cycle begins where the tour first meets it; on its first lap it takes in the cycles that it meets, and its other laps are one stretch.
    """
    out: dict[object, list[int]] = defaultdict(list)
    surplus: dict[object, int] = defaultdict(int)
    left = [n for _, _, n in edges]
    for i, (a, b, n) in enumerate(edges):
        if n > 0:
            out[a].append(i)
            surplus[a] += n
            surplus[b] -= n
    if not out:
        return []
    start = min((x for x in surplus if surplus[x] > 0), default=min(out))
    cycles: list[tuple[list[int], int]] = []
    through: dict[object, list[tuple[int, int]]] = defaultdict(list)  # node -> (cycle, place of its edge that leaves the node)

    def strip(node: object) -> list[int]:
        """Walks on until no edge is left and cuts every cycle out of the way; what remains is a path."""
        path: list[int] = []
        nodes, place = [node], {node: 0}
        while True:
            own = out[nodes[-1]]
            while own and not left[own[-1]]:
                own.pop()
            if not own:
                return path
            edge, to = own[-1], edges[own[-1]][1]
            path.append(edge)
            if to not in place:
                place[to] = len(nodes)
                nodes.append(to)
                continue
            at = place[to]
            ring = path[at:]
            laps = min(left[e] for e in ring)
            for i, e in enumerate(ring):
                left[e] -= laps
                through[edges[e][0]].append((len(cycles), i))
            cycles.append((ring, laps))
            for x in nodes[at + 1 :]:
                del place[x]
            del path[at:], nodes[at + 1 :]

    way = strip(start)
    for e in way:
        left[e] -= 1
    for node in list(out):
        strip(node)

    found: list[tuple[list[int], int]] = []
    literal: list[int] = []
    taken = [False] * len(cycles)

    def met(node: object) -> tuple[list[int], int] | None:
        waiting = through[node]
        while waiting:
            i, at = waiting.pop()
            if not taken[i]:
                taken[i] = True
                ring, laps = cycles[i]
                return ring[at:] + ring[:at], laps
        return None

    stack = [(way, 1, 0)]
    while stack:
        own, laps, at = stack.pop()
        node = edges[own[at]][0] if at < len(own) else edges[own[-1]][1] if own else start
        if (ring := met(node)) is not None:
            stack += [(own, laps, at), (*ring, 0)]
        elif at < len(own):
            literal.append(own[at])
            stack.append((own, laps, at + 1))
        elif laps > 1:
            if literal:
                found.append((literal, 1))
                literal = []
            found.append((own, laps - 1))
    return [*found, (literal, 1)] if literal else found


def euler_tours(edges: DataFrame, in_one_task: int = TOUR_EDGES, planned: int = PLAN_EDGES) -> DataFrame:
    """component, step, src, dst, label: every edge (n times) and every restart edge (label null) once, in the order of a tour of its component. edges: src, dst (bigint), label, n.

    Components are counted first: those of up to ``in_one_task`` edges are walked, each in a task. Of the others, those of up to ``planned`` different edges are planned without their
    copies (see ``planned_tour``) and laid out by all tasks; the rest are toured by joins (see ``_tours_by_joins``).
    """
    member = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(member, "node", "left_anti").select("node", F.col("node").alias("component"))
    member = cut(member.unionByName(alone))
    counted = edges.select("src", "dst", "label", F.col("n").cast("bigint").alias("n")).where("n > 0").join(member.withColumnRenamed("node", "src"), "src")
    closing = cut(balance(edges, close=True).withColumn("id", F.monotonically_increasing_id()))
    last = closing.groupBy("component").agg(F.max("id").alias("id")).withColumn("spare", F.lit(True))
    restarts = closing.join(last, ["component", "id"], "left").groupBy("component", "src", "dst", F.coalesce("spare", F.lit(False)).alias("spare")).agg(F.count("*").alias("n"))
    every = counted.select("component", "src", "dst", "label", F.lit(False).alias("restart"), F.lit(False).alias("spare"), "n").unionByName(
        restarts.select("component", "src", "dst", F.lit(None).cast("string").alias("label"), F.lit(True).alias("restart"), "spare", "n")
    )
    every = cut(every)
    sizes = every.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("different"))
    way = F.when(F.col("size") <= in_one_task, "walk").when(F.col("different") <= planned, "plan").otherwise("join")
    sizes = cut(sizes.select("component", way.alias("way")))
    chosen = lambda way: every.join(sizes.where(F.col("way") == way).select("component"), "component", "left_semi")
    copies = lambda rows: rows.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("n")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = tour(list(zip(pdf["src"], pdf["dst"], pdf["label"], strict=True)))
        return pd.DataFrame([(pdf["component"].iloc[0], i, *r) for i, r in enumerate(rows)], columns=["component", "step", "src", "dst", "label"])

    out = copies(chosen("walk").where("not spare")).select("component", "src", "dst", "label").groupBy("component").applyInPandas(walk, "component bigint, step bigint, src bigint, dst bigint, label string")
    if not sizes.where("way = 'plan'").isEmpty():
        out = out.unionByName(_tours_by_plan(chosen("plan").where("not spare")))
    if not sizes.where("way = 'join'").isEmpty():
        out = out.unionByName(_tours_by_joins(copies(chosen("join"))))
    return out


def _tours_by_plan(every: DataFrame) -> DataFrame:
    """The same of components of few different edges with many copies. every: component, src, dst, label, n, without spare edges. Only the plans are made in one task each."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ends = list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["n"].tolist(), strict=True))
        rows, first = [], 0
        for own, laps in planned_tour(ends):
            for at in range(0, len(own), LAID_AT_ONCE) if laps == 1 else [0]:
                part = own[at : at + LAID_AT_ONCE] if laps == 1 else own
                rows.append((pdf["component"].iloc[0], first, laps, part))
                first += len(part) * laps
        return pd.DataFrame(rows, columns=["component", "first", "laps", "way"])

    numbered_edges = cut(every.withColumn("id", F.row_number().over(Window.partitionBy("component").orderBy("src", "dst", F.col("label").asc_nulls_last())) - 1))
    plans = cut(numbered_edges.select("component", "id", "src", "dst", "n").groupBy("component").applyInPandas(plan, "component bigint, first bigint, laps bigint, way array<int>"))
    size = F.size("way").cast("bigint")
    at_once = F.greatest(F.floor(F.lit(LAID_AT_ONCE) / size), F.lit(1)).cast("bigint")
    blocks = plans.withColumn("k", at_once).withColumn("lap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("laps") - 1, "k")))
    blocks = blocks.select("component", (F.col("first") + F.col("lap") * size).alias("first"), F.least("k", F.col("laps") - F.col("lap")).alias("laps"), "way")
    dealt = blocks.repartition(8 * parts_of(every), "component", "first")
    laid = dealt.select("component", "first", size.alias("size"), "way", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("laps") - 1)).alias("lap"))
    steps = laid.select("component", F.col("first").alias("base"), "size", "lap", F.posexplode("way").alias("i", "id")).select("component", "id", (F.col("base") + F.col("lap") * F.col("size") + F.col("i")).alias("step"))
    known = numbered_edges.select("component", F.col("id").cast("int").alias("id"), "src", "dst", "label")
    if known.count() <= PLAN_EDGES * 4:
        known = F.broadcast(known)
    return steps.join(known, ["component", "id"]).select("component", "step", "src", "dst", "label")


def _tours_by_joins(every: DataFrame) -> DataFrame:
    """The same of large components. every: component, src, dst, label, restart, spare (the restart edge too many, if there are any), so that each node has as many ways in as out.

    At every node the i-th way in goes on by the i-th way out, which makes cycles; cycles are
    labelled as components, and those that meet are joined along a spanning forest of cycles and nodes by handing their ways on round the node; what is then one cycle a
    component is cut open (at the spare edge, if there is one) and numbered by pointer doubling. No component or node is one group.
    """
    every = cut(every.withColumn("id", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("bigint")))
    ways_in = running(every, ["dst", "id"], ["dst", "id"], ("one",), key="dst").select(F.col("dst").alias("node"), F.col("one_to").alias("i"), F.col("id").alias("come"))
    ways_out = running(every, ["src", "id"], ["src", "id"], ("one",), key="src").select(F.col("src").alias("node"), F.col("one_to").alias("i"), F.col("id").alias("go"))
    turns = cut(ways_in.join(ways_out, ["node", "i"]).select("node", "come", "go"))

    cycles = components(turns.select(F.col("come").alias("a"), F.col("go").alias("b")))
    labelled = cut(turns.join(cycles.select(F.col("node").alias("come"), F.col("component").alias("cycle")), "come", "left").withColumn("cycle", F.coalesce("cycle", "come")))
    met = labelled.groupBy("node", "cycle").agg(F.min("come").alias("come"))
    shared = cut(met.join(met.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select("node"), "node"))
    if not shared.isEmpty():
        # cycles and nodes as one kind of number: even and odd
        tree = spanning_forest(shared.select((F.col("cycle") * 2).alias("a"), (F.col("node") * 2 + 1).alias("b")))
        joined = shared.join(tree.select(F.expr("a div 2").alias("cycle"), F.expr("(b - 1) div 2").alias("node")), ["cycle", "node"])
        ranked = running(joined.withColumn("i", F.lit(1).cast("bigint")), ["node", "cycle"], ["node", "come"], ("i",), key="node").withColumnRenamed("i_to", "i")
        after = ranked.join(ranked.groupBy("node").agg(F.max("i").alias("k")), "node").select("node", "come", (F.col("i") % F.col("k") + 1).alias("i"))
        given = after.join(ranked.withColumnRenamed("come", "taken"), ["node", "i"]).select("come", "taken")
        other = turns.select(F.col("come").alias("taken"), F.col("go").alias("go2"))
        turns = turns.join(given.join(other, "taken").select("come", "go2"), "come", "left").select("come", F.coalesce("go2", "go").alias("go"))

    # a component's cycle ends with its spare edge, which is then left out, or else with the edge of the greatest id
    ends = every.groupBy("component").agg(F.max(F.struct("spare", "id")).alias("e")).select(F.col("e.id").alias("come"))
    nexts = turns.join(ends.withColumn("ends", F.lit(True)), "come", "left").select(F.col("come").alias("id"), F.when(F.col("ends").isNull(), F.col("go")).alias("next"))
    ranks = list_ranks(nexts)
    sizes = ranks.groupBy("last").agg(F.max("left").alias("most"))
    placed = every.join(ranks, "id").join(sizes, "last").where("not spare")
    return placed.select("component", (F.col("most") - F.col("left")).alias("step"), "src", "dst", "label")


def edge_words(edges: DataFrame, m: int) -> DataFrame:
    """edge, offset, word: the words of m + 1 letters along each edge, one for each letter of its label. edges: edge (a number), src, label, with sources of m letters."""
    spelt = edges.select(F.col("edge").alias("entry_id"), F.concat("src", "label").alias("seq"))
    return words(spelt, m + 1).select(F.col("entry_id").alias("edge"), F.col("pos").alias("offset"), F.col("kmer").alias("word"))


def path_counts(sequences: DataFrame, edges: DataFrame, m: int) -> DataFrame:
    """entry_id, pos, n: count of the graph's edges at each (m+1)-word of the sequences, 0 where they have none. edges: src, label (of any length), n."""
    table = sized(along(edges, m), m + 9)
    return words(sequences, m + 1).join(table.withColumnRenamed("word", "kmer"), "kmer", "left").select("entry_id", "pos", F.coalesce("n", F.lit(0)).alias("n"))


def along(edges: DataFrame, m: int) -> DataFrame:
    """word, n: the words of m + 1 letters along the edges, with the counts of all edges that they stand on."""
    known = cut(edges.withColumn("edge", F.monotonically_increasing_id()).select("edge", "src", "label", "n"))
    return edge_words(known, m).hint("merge").join(known.select("edge", "n"), "edge").groupBy("word").agg(F.sum("n").alias("n"))


#: Up to so many different words are sent to the tasks that list places, so that no others are listed.
FEW = 1 << 16


def _placed(reads: DataFrame, of_words: DataFrame, k: int, width: int, few: bool = False) -> DataFrame:
    """The places of the reads (entry_id, pos) joined with a table of words (column kmer); words of A, C, G and T by their numbers. width: bytes of a row's keys; few: most places may have no such word."""
    table = sized(of_words, width)
    if k > CODED or not table.where(F.col("kmer").rlike("[^ACGT]")).isEmpty():
        return words(reads, k).withColumn("pos", F.col("pos").cast("bigint")).join(table, "kmer")
    by_code = table.withColumn("code", S.kmer_code("kmer").cast("bigint"))
    codes = by_code.select("code").distinct()
    only = [r.code for r in codes.collect()] if few and codes.limit(FEW + 1).count() <= FEW else None
    return coded_words(reads, k, only).join(by_code, "code").drop("code")


def edge_passages(reads: DataFrame, edges: DataFrame, m: int) -> DataFrame:
    """entry_id, src, dst, label, n, start, first, last: where reads go along edges whose labels have any lengths.

    Every (m+1)-word of a read is looked up among the words along the edges, all reads and places at once; words that follow each other on an edge are one
    passage of it, from its letter ``first`` to ``last`` (all of them, unless the read begins or ends there or differs); start: where the edge's source would stand in the read. No read is
    gathered. An edge of one letter is passed at one place, so only places on longer ones are exchanged and sorted. reads: entry_id, seq; edges: src, dst, label, n.
    """
    known = cut(edges.select("src", "dst", "label", "n").withColumn("edge", F.monotonically_increasing_id()))
    zero = F.lit(0).cast("bigint")
    short = known.where("length(label) = 1").select(F.concat("src", "label").alias("kmer"), "edge", "src", "dst", "label", "n")
    at_once = _placed(reads, short, m + 1, 3 * m + 26).select("entry_id", "edge", "src", "dst", "label", "n", F.col("pos").alias("start"), zero.alias("first"), zero.alias("last"))
    far = known.where("length(label) > 1")
    if far.isEmpty():
        return at_once
    placed = _placed(reads, edge_words(far, m).withColumnRenamed("word", "kmer"), m + 1, m + 17, few=True)
    # on one edge and one diagonal, words that follow each other differ from their rank by one number
    on = placed.select("entry_id", "edge", (F.col("pos") - F.col("offset")).alias("start"), F.col("offset").cast("bigint").alias("offset"))
    order = Window.partitionBy("entry_id", "edge", "start").orderBy("offset")  # as many rows as an edge has letters
    runs = on.withColumn("run", F.col("offset") - F.row_number().over(order)).groupBy("entry_id", "edge", "start", "run").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    return at_once.unionByName(runs.join(far, "edge").select(*at_once.columns))


def threaded(reads: DataFrame, edges: DataFrame, m: int) -> DataFrame:
    """entry_id, thread, step, src, dst, label, n, start, first, last: the ways of reads through a graph. Passages (see ``edge_passages``) of whole edges that meet are steps (from 0) of one thread (from 1 in the read)."""
    found = cut(edge_passages(reads, edges, m).withColumn("size", F.length("label").cast("bigint")))
    before = found.where("last = size - 1").select("entry_id", (F.col("start") + F.col("size")).alias("start"), F.col("dst").alias("src"), F.lit(1).alias("goes_on")).distinct()
    linked = found.join(before, ["entry_id", "start", "src"], "left")
    fresh = (F.col("goes_on").isNull() | (F.col("first") > 0)).cast("bigint")
    ordered = linked.withColumn("thread", fresh).withColumn("step", F.lit(1).cast("bigint"))
    keep = ["entry_id", "src", "dst", "label", "n", "start", "first", "last", "thread"]
    laid = running(ordered, ["entry_id", F.col("start") + F.col("first"), "edge"], keep, ("thread", "step"), key="entry_id")
    begins = laid.where("thread = 1").select("entry_id", F.col("thread_to").alias("thread_to"), F.col("step_to").alias("begin"))
    return laid.join(begins, ["entry_id", "thread_to"]).select("entry_id", F.col("thread_to").alias("thread"), (F.col("step_to") - F.col("begin")).alias("step"), "src", "dst", "label", "n", "start", "first", "last")


def overlaps(left: DataFrame, right: DataFrame, shortest: int, longest: int) -> DataFrame:
    """a, b, overlap: the longest suffix of a left sequence that is a prefix of a right one. left: a, seq; right: b, seq."""
    size = F.explode(F.sequence(F.lit(shortest), F.lit(longest)))
    ends = left.select("a", "seq", size.alias("n")).where("n <= length(seq)").select("a", "n", F.expr("right(seq, n)").alias("word"))
    starts = right.select("b", "seq", size.alias("n")).where("n <= length(seq)").select("b", "n", F.expr("left(seq, n)").alias("word"))
    return ends.join(starts, ["n", "word"]).where("a != b").groupBy("a", "b").agg(F.max("n").alias("overlap"))


def nearest_overlaps(left: DataFrame, right: DataFrame, shortest: int, longest: int, most: int) -> DataFrame:
    """a, b, overlap: of the pairs of ``overlaps`` the first ``most`` of each a, longest overlap first, ties by b. Null sequences and those shorter than ``shortest`` have none.

    No list of all pairs is made: of the right sequences that begin with one word only the first 2 * most are kept, before rows are exchanged. That is enough: at one length
    an a leaves out itself and what it took at greater lengths, fewer than ``most``, and takes ``most`` at most.
    """
    size = F.explode(F.sequence(F.lit(shortest), F.lit(longest)))
    long_enough = lambda d, key, end: d.select(key, end.alias("end"), size.alias("n")).where("n <= length(end)")
    ends = long_enough(left, "a", F.expr(f"right(seq, {longest})")).select("a", "n", F.expr("right(end, n)").alias("word"))
    starts = long_enough(right, "b", F.expr(f"left(seq, {longest})")).select("b", "n", F.expr("left(end, n)").alias("word")).distinct()
    first = starts.withColumn("i", F.row_number().over(Window.partitionBy("n", "word").orderBy("b"))).where(F.col("i") <= 2 * most).groupBy("n", "word").agg(F.collect_list("b").alias("all"))
    found = ends.hint("merge").join(first, ["n", "word"]).select("a", "n", F.explode("all").alias("b")).where("a != b").groupBy("a", "b").agg(F.max("n").alias("overlap"))
    best = Window.partitionBy("a").orderBy(F.desc("overlap"), "b")
    return found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= most).drop("i")


def jumpers(deficit: DataFrame, surplus: DataFrame, m: int, shortest: int = 7, most: int = 11) -> DataFrame:
    """a, b, overlap, cost: from each node that needs a way on, at most ``most`` cheapest edges by overlap; cost = m - 1 - overlap."""
    return nearest_overlaps(deficit, surplus, shortest, m - 1, most).withColumn("cost", F.lit(m - 1) - F.col("overlap"))


def shortcuts(edges: DataFrame, longest: int, most: int | None = None) -> DataFrame:
    """src (a deficit node), dst (a surplus node), cost: the letters of the shortest path from one to the other, where they are at most ``longest``; with ``most``, the nearest so many of each dst, ties by src.

    The search goes backward from all surplus nodes at once: a round joins what got nearer with the edges that lead there, and as an edge has a letter
    at least there are ``longest`` rounds at most. Only (dst, node) minima are kept. Each path, walked once more, takes a unit from its src to its dst. edges: src, dst, label, n.
    """
    edges = cut(edges.select("src", "dst", "label", "n"))
    d = cut(degrees(edges))
    steps = cut(edges.groupBy("src", "dst").agg(F.min(F.length("label")).cast("bigint").alias("letters")))
    reached = d.where("surplus > 0").select(F.col("node").alias("root"), "node", F.lit(0).cast("bigint").alias("cost"), F.lit(True).alias("new"))
    for _ in range(longest):
        back = reached.where("new").join(steps.withColumnRenamed("dst", "node"), "node").select("root", F.col("src").alias("node"), (F.col("cost") + F.col("letters")).alias("cost"), F.lit(True).alias("new"))
        every = reached.withColumn("new", F.lit(False)).unionByName(back.where(F.col("cost") <= longest))
        nearest = every.groupBy("root", "node").agg(F.min(F.struct("cost", "new")).alias("x"))  # at one cost what is known comes before what is new
        reached = cut(nearest.select("root", "node", "x.cost", "x.new"))
        if reached.where("new").isEmpty():
            break
    out = reached.join(d.where("surplus < 0").select("node"), "node", "left_semi").select(F.col("node").alias("src"), F.col("root").alias("dst"), "cost")
    if most is None:
        return out
    order = Window.partitionBy("dst").orderBy("cost", "src")
    return out.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).drop("i")


def transport(supply: dict, demand: dict, costs: dict[tuple, float], method: str = "optimal") -> dict[tuple, int]:
    """Units by (source, sink) along the given edges. greedy: cheapest edge first; vogel: largest regret first; optimal: successive shortest paths, which send all that can be sent at least cost."""
    supply, demand, flow = dict(supply), dict(demand), defaultdict(int)
    if method in ("greedy", "vogel"):
        while True:
            open_edges = [(c, e) for e, c in costs.items() if supply.get(e[0], 0) > 0 and demand.get(e[1], 0) > 0]
            if not open_edges:
                return dict(flow)
            if method == "greedy":
                _, edge = min(open_edges, key=lambda x: (x[0], str(x[1])))
            else:
                by: dict = defaultdict(list)
                for c, (a, b) in open_edges:
                    by["s", a].append(c)
                    by["d", b].append(c)
                regret = {k: (s[1] - s[0] if len(s) > 1 else s[0]) for k, s in ((k, sorted(v)) for k, v in by.items())}
                _, edge = min(open_edges, key=lambda x: (-max(regret["s", x[1][0]], regret["d", x[1][1]]), x[0], str(x[1])))
            units = min(supply[edge[0]], demand[edge[1]])
            supply[edge[0]] -= units
            demand[edge[1]] -= units
            flow[edge] += units
    while True:
        distance: dict = {("s", a): 0.0 for a, u in supply.items() if u > 0}
        via: dict = {}
        for _ in range(len(supply) + len(demand)):  # Bellman-Ford over the residual network
            changed = False
            for (a, b), c in costs.items():
                for x, y, w, ok in ((("s", a), ("d", b), c, True), (("d", b), ("s", a), -c, flow[a, b] > 0)):
                    if ok and x in distance and distance[x] + w < distance.get(y, float("inf")) - 1e-12:
                        distance[y], via[y], changed = distance[x] + w, (x, (a, b)), True
            if not changed:
                break
        ends = [b for b, u in demand.items() if u > 0 and ("d", b) in distance]
        if not ends:
            return {e: u for e, u in flow.items() if u}
        end = min(ends, key=lambda b: (distance["d", b], str(b)))
        path, at = [], ("d", end)
        while at in via:
            before, edge = via[at]
            path.append((edge, 1 if before[0] == "s" else -1))
            at = before
        units = min([supply[at[1]], demand[end], *(flow[e] for e, sign in path if sign < 0)])
        for edge, sign in path:
            flow[edge] += sign * units
        supply[at[1]] -= units
        demand[end] -= units


def transported(units: DataFrame, edges: DataFrame, method: str = "optimal") -> DataFrame:
    """component, src, dst, units by solving the problem of each component. units: component, node, surplus; edges: component, src (a deficit node), dst (a surplus node), cost."""
    kind = dict(edges.dtypes)
    rows = edges.select("component", "src", "dst", "cost", F.lit(None).cast("bigint").alias("surplus")).unionByName(units.select("component", F.col("node").alias("src"), F.lit(None).cast(kind["dst"]).alias("dst"), F.lit(None).cast(kind["cost"]).alias("cost"), "surplus"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["surplus"].notna()]
        ways = pdf[pdf["surplus"].isna()]
        need = {a: int(-s) for a, s in zip(nodes["src"], nodes["surplus"], strict=True) if s < 0}
        have = {a: int(s) for a, s in zip(nodes["src"], nodes["surplus"], strict=True) if s > 0}
        flow = transport(need, have, {(a, b): float(c) for a, b, c in zip(ways["src"], ways["dst"], ways["cost"], strict=True)}, method)
        return pd.DataFrame([(pdf["component"].iloc[0], a, b, u) for (a, b), u in sorted(flow.items(), key=str)], columns=["component", "src", "dst", "units"])

    return rows.groupBy("component").applyInPandas(solve, f"component {kind['component']}, src {kind['src']}, dst {kind['dst']}, units bigint")


def numbered_graph(edges: DataFrame) -> DataFrame:
    """Edges of words by number: src, dst, label, n, src_seq, dst_seq. Written once, as what follows reads edges many times and the words they come from shall be listed once."""
    edges = cut(edges.select("src", "dst", "label", "n"))
    nodes = numbered(edges.select(F.col("src").alias("kmer")).unionByName(edges.select(F.col("dst").alias("kmer"))))
    nodes = cut(nodes)
    out = edges.select(F.col("src").alias("src_seq"), F.col("dst").alias("dst_seq"), "label", "n")
    out = out.join(nodes.select(F.col("id").alias("src"), F.col("seq").alias("src_seq")), "src_seq").join(nodes.select(F.col("id").alias("dst"), F.col("seq").alias("dst_seq")), "dst_seq")
    return cut(out.select("src", "dst", "label", "n", "src_seq", "dst_seq"))
