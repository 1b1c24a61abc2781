"""Repairs and annotations of word graphs: repeats resolved by reads, components chained, terminators cut out, tracks.

edges: src, dst (words of one length), label (the letters that the step adds), n. A node's copies are named word#source edge.
Null or empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.lineage import cut, release
from . import match
from .graph import FEW, along, components, degrees, numbered, path_counts, text_graph, unitigs
from .kmers import CODED, value_runs


def widgets(edges: DataFrame) -> DataFrame:
    """x, y, inner: where several ways in meet several ways out. Either one node (x = y, inner empty), or an edge, labelled inner, from a node with one way out to one with one way in. edges: of unitigs, so that longer ways between are one edge."""
    ins = edges.groupBy("dst").agg(F.count("*").alias("i")).select(F.col("dst").alias("node"), "i")
    outs = edges.groupBy("src").agg(F.count("*").alias("o")).select(F.col("src").alias("node"), "o")
    both = cut(ins.join(outs, "node"))
    one = both.where("i > 1 and o > 1").select(F.col("node").alias("x"), F.col("node").alias("y"), F.lit("").alias("inner"))
    starts, ends = both.where("i > 1 and o = 1").select(F.col("node").alias("x")), both.where("i = 1 and o > 1").select(F.col("node").alias("y"))
    two = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("label").alias("inner")).join(starts, "x").join(ends, "y").select("x", "y", "inner")
    return one.unionByName(two)


def resolved_by_reads(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """src, dst, label, n after one round of repeat resolution.

    A way through a widget is an edge in, the widget and an edge out; it is confirmed if a read (entry_id, seq) holds all its letters.
    A widget is resolved if every edge in and every edge out is on a confirmed way: its first edge in (by source and label) keeps it, each further one gets a copy, whose
    edges count 1, and only confirmed ways remain. Of neighbouring widgets, the one with the smallest node goes first; run further rounds for the others.
    Both sides of a widget have as many edges as the alphabet has letters at most, so its ways are few.
    """
    own = cut(edges.select("src", "dst", "label", "n"))
    found = cut(widgets(own))
    name = lambda *c: F.concat_ws(",", *c)
    member = found.select("x", F.explode(F.array_distinct(F.array("x", "y"))).alias("node"))
    into = own.select(F.col("dst").alias("x"), F.col("src").alias("u"), F.col("label").alias("label_in"), name("src", "label").alias("a")).join(found, "x")
    out_of = own.select(F.col("src").alias("y"), F.col("dst").alias("v"), F.col("label").alias("label_out"), name("dst", "label").alias("b")).join(found.select("x", "y"), "y")
    around = into.select("x", F.col("u").alias("node")).unionByName(out_of.select("x", F.col("v").alias("node")))
    later = around.join(member.withColumnRenamed("x", "other"), "node").where("other <= x").select("x").distinct()
    into, out_of = (cut(t.join(later, "x", "left_anti")) for t in (into, out_of))

    text = F.concat(F.substring_index("u", "#", 1), "label_in", "inner", "label_out")
    ways = cut(into.join(out_of.drop("y"), "x").select("x", "y", "inner", "u", "a", "label_in", "v", "b", "label_out", text.alias("pattern")))
    asked = ways.select("pattern").distinct().select(F.xxhash64("pattern").alias("pattern_id"), "pattern")
    hits = match.exact(reads, asked).select("pattern_id").distinct()
    sure = cut(ways.join(asked.join(hits, "pattern_id", "left_semi").select("pattern"), "pattern", "left_semi"))

    wanted = into.groupBy("x").agg(F.count("*").alias("n_in")).join(out_of.groupBy("x").agg(F.count("*").alias("n_out")), "x")
    covered = sure.groupBy("x").agg(F.count_distinct("a").alias("c_in"), F.count_distinct("b").alias("c_out"), F.min("a").alias("first"))
    good = wanted.join(covered, "x").where("n_in = c_in and n_out = c_out").select("x", "first")
    sure = cut(sure.join(good, "x").withColumn("kept", F.col("a") == F.col("first")))

    copy = lambda c: F.concat(c, F.lit("#"), "a")
    moved = sure.where("not kept")
    gone_in = moved.select(F.col("u").alias("src"), F.col("x").alias("dst"), F.col("label_in").alias("label")).distinct()
    stay_out = sure.where("kept").select(F.col("y").alias("src"), F.col("v").alias("dst"), F.col("label_out").alias("label"))
    all_out = sure.select(F.col("y").alias("src"), F.col("v").alias("dst"), F.col("label_out").alias("label")).distinct()
    gone = gone_in.unionByName(all_out.join(stay_out, ["src", "dst", "label"], "left_anti"))
    one = F.lit(1).cast(own.schema["n"].dataType).alias("n")
    fresh = moved.select(F.col("u").alias("src"), copy("x").alias("dst"), F.col("label_in").alias("label"), one)
    fresh = fresh.unionByName(moved.where("x != y").select(copy("x").alias("src"), copy("y").alias("dst"), F.col("inner").alias("label"), one)).distinct()
    fresh = fresh.unionByName(moved.select(copy("y").alias("src"), F.col("v").alias("dst"), F.col("label_out").alias("label"), one))
    return own.join(gone, ["src", "dst", "label"], "left_anti").select("src", "dst", "label", "n").unionByName(fresh)


def contracted(edges: DataFrame) -> DataFrame:
    """src, dst, label, n: the edges with paths through nodes of one way in and out drawn together; a path has the least of its counts."""
    return unitigs(edges, whole=True).select(F.col("head").alias("src"), F.col("tail").alias("dst"), "label", "n")


def resolved(edges: DataFrame, reads: DataFrame, rounds: int = 100) -> DataFrame:
    """src, dst, label, n: rounds of ``resolved_by_reads``, the graph drawn together before each, until no widget is confirmed.

    In a round all widgets go at once that have no smaller one beside them, so many rounds come only of long rows of widgets. A widget that is resolved has no node with several
    ways in and out left, and copies have fewer ways than what they are copies of, so it ends.
    """
    now = cut(contracted(edges))
    for _ in range(rounds):
        new = cut(contracted(resolved_by_reads(now, reads)))
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            return new
        release(now)
        now = new
    raise RuntimeError("repeats did not settle")


def assembled(reads: DataFrame, m: int) -> DataFrame:
    """src, dst, n, text: reads to the longest stretches that they tell: their word graph, drawn together, with repeats resolved by the reads; text: the letters of an edge with those of its source."""
    edges = text_graph(reads, m).select("src", "dst", "label", "n")
    return resolved(edges, reads).select("src", "dst", "n", F.concat(F.substring_index("src", "#", 1), "label").alias("text"))


def joined_components(edges: DataFrame, terminator: str = "$") -> DataFrame:
    """src, dst, label of edges that chain components: from the smallest node with more ways in than out of one to the smallest with more out than in of the next.

    Components with both kinds of node form one chain, in order; the first of those with only the former kind stands before it, the first of those with only the
    latter after it, and further ones of these two pair up in order. Balanced components stay alone. The label is the terminator and the target's word.
    """
    own = degrees(edges).join(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "node")
    ends = cut(own.groupBy("component").agg(F.min(F.when(F.col("surplus") < 0, F.col("node"))).alias("tail"), F.min(F.when(F.col("surplus") > 0, F.col("node"))).alias("head")))

    def placed(condition: str) -> DataFrame:
        chosen = ends.where(condition)
        return chosen.join(numbered(chosen.select("component"), "component").withColumnRenamed("seq", "component"), "component").select("id", "tail", "head")

    middle = cut(placed("tail is not null and head is not null"))
    n = middle.count()
    chain = middle.select(F.lit(1).cast("bigint").alias("chain"), F.col("id").alias("place"), "tail", "head")
    before = placed("tail is not null and head is null").select(F.col("id").alias("chain"), F.lit(0).cast("bigint").alias("place"), "tail", "head")
    after = placed("tail is null and head is not null").select(F.col("id").alias("chain"), F.when(F.col("id") == 1, F.lit(n + 1)).otherwise(F.lit(1)).cast("bigint").alias("place"), "tail", "head")
    links = cut(before.unionByName(chain).unionByName(after))
    tails = links.where("tail is not null").select("chain", (F.col("place") + 1).alias("place"), F.col("tail").alias("src"))
    heads = links.where("head is not null").select("chain", "place", F.col("head").alias("dst"))
    return tails.join(heads, ["chain", "place"]).select("src", "dst", F.concat(F.lit(terminator), F.col("dst").cast("string")).alias("label"))


def without_terminators(edges: DataFrame, m: int, terminator: str = "$") -> DataFrame:
    """src, dst, label, n: the edges cut at terminators, so that no word of m letters holds one; equal pieces add up, and pieces of one word alone are no edge."""
    piece = F.explode(F.split(F.concat("src", "label"), rf"\Q{terminator}\E", -1)).alias("piece")
    cut_up = edges.select("n", piece).where(F.length("piece") > m)
    return cut_up.select(F.expr(f"left(piece, {int(m)})").alias("src"), F.expr(f"right(piece, {int(m)})").alias("dst"), F.expr(f"substring(piece, {int(m) + 1})").alias("label"), "n").groupBy("src", "dst", "label").agg(F.sum("n").alias("n"))


#: What a count is shown as.
TRANSFORMS = {
    "count": lambda n: n,
    "log2": lambda n: F.when(n > 0, F.floor(F.log2(n.cast("double")) + 0.001) + 1).otherwise(F.lit(0)),
    "unique": lambda n: F.when(n > 1, F.lit(2)).otherwise(F.lit(1)),
}


def path_tracks(counts: DataFrame, m: int, transform: str = "count", every: bool = False) -> DataFrame:
    """entry_id, start, stop, value: maximal stretches of letters whose edges have one value; those of value 1 or less only with ``every``. counts: as path_counts of m-letter nodes makes them."""
    shown = counts.select("entry_id", (F.col("pos") + m).cast("bigint").alias("at"), TRANSFORMS[transform](F.col("n")).cast("bigint").alias("value"))
    if not every:
        shown = shown.where("value > 1")
    order = Window.partitionBy("entry_id", "value").orderBy("at")
    islands = shown.withColumn("island", F.col("at") - F.row_number().over(order))
    return islands.groupBy("entry_id", "value", "island").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop")).select("entry_id", "start", "stop", "value")


def text_tracks(sequences: DataFrame, edges: DataFrame, m: int, transform: str = "count", every: bool = False) -> DataFrame:
    """``path_tracks`` of the ``path_counts`` of whole sequences. Up to ``FEW`` words along the edges are sent to the tasks, which find the stretches of a piece at once; no place is joined or sorted then."""
    own = cut(along(edges, m))
    if m >= CODED or own.count() > FEW or not own.where(F.col("word").rlike("[^ACGT]")).isEmpty():
        return path_tracks(path_counts(sequences, edges, m), m, transform, every)
    known = own.select(S.kmer_code("word").alias("code"), TRANSFORMS[transform](F.col("n")).cast("bigint").alias("value")).collect()
    other = own.sparkSession.range(1).select(TRANSFORMS[transform](F.lit(0).cast("bigint")).cast("bigint")).first()[0]
    found = value_runs(sequences, m + 1, [r.code for r in known], [r.value for r in known], other, None if every else 2)
    return found.select("entry_id", (F.col("start") + m).alias("start"), (F.col("stop") + m).alias("stop"), "value")


def value_letter(value: Column) -> Column:
    """a for 0, b for 1, up to z for 25 and more."""
    return F.char(F.lit(97) + F.least(value, F.lit(25)))
