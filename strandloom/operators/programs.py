"""Whole programs composed of the operators: primer search, pairs of primers, peptides with mutations, unmatched regions, spaced seeds.

patterns: pattern_id (1..n), pattern. Columns are named as the format codes of ``plans.formats`` expect them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.lineage import cut
from . import align, match, pairs, runs
from .kmers import BEYOND, fits, windows


def _marks(text: str, pattern: str) -> Column:
    return F.array_join(F.zip_with(F.split(text, ""), F.split(pattern, ""), lambda a, b: F.when(a == b, F.lit("|")).otherwise(F.lit("*"))), "")


def primer_match(sequences: DataFrame, primers: DataFrame, k: int = 0, both: bool = True, upper: bool = False, word: int | None = None, indels: bool = False, **exact: int) -> DataFrame:
    """Hits with up to k substitutions (or, with indels, edits) of each primer, of both strands if asked, and all that an alignment line tells of them.

    exact: five, three, start, end and their inexact forms (see ``functions.seq.constraints``): letters that take no error, counted on
    the primer, so on the reverse strand 5' and 3' change sides. upper: primers are read in upper case.
    five and three are the hit's end coordinates in the primer's direction; text_forward is the hit as the primer reads it. text_gaps and pattern_gaps are the
    alignment's rows. With indels a hit is a cluster of ends (first_end, last_end) and the best alignment that ends in it; edits are those of the alignment.
    """
    own = primers.select("pattern_id", (F.upper("pattern") if upper else F.col("pattern")).alias("pattern"))
    strands = match.both_strands(own) if both else own.select("pattern_id", F.col("pattern_id").alias("base_id"), F.lit("F").alias("strand"), "pattern")
    forward = own.select(F.col("pattern_id").alias("base_id"), F.col("pattern").alias("forward_pattern"))
    back, n, zero = F.col("strand") == "R", F.length("pattern"), F.lit(0)
    turned = {"five": "three", "three": "five", "five_inexact": "three_inexact", "three_inexact": "five_inexact"}
    sides = zip(S.constraints(n, **{turned.get(x, x): v for x, v in exact.items()}), S.constraints(n, **exact), strict=True) if exact else [(zero, zero)] * 2
    left, right = (F.when(back, reverse).otherwise(plain).cast("int") for reverse, plain in sides)
    about = F.broadcast(strands.drop("pattern").join(forward, "base_id"))  # of the primers alone
    if indels:
        found = match.clusters(match.edit_ends(sequences, strands, k, word, with_text=True), k).join(about, "pattern_id")
        aligned = align.aligned("text", "pattern", "first_end", "last_end", k, left=left, right=right)
        hits = found.withColumn("a", aligned).where("a is not null").select(
            *(c for c in found.columns if c not in ("text", "edits")), "a.edits", F.col("a.start").alias("start_pos"), F.col("a.end").alias("end_pos"), F.replace("a.text", F.lit("-"), F.lit("")).alias("text"),
            "a.ops", F.col("a.text").alias("text_gaps"), F.col("a.pattern").alias("pattern_gaps"),
        )
    else:
        hits = match.found(sequences, strands, k, word).join(about, "pattern_id")
        if exact:
            hits = hits.where((F.left("text", left) == F.left("pattern", left)) & (F.right("text", right) == F.right("pattern", right)))
        hits = hits.withColumn("ops", _marks("text", "pattern")).withColumn("text_gaps", F.col("text")).withColumn("pattern_gaps", F.col("pattern"))
    marked = lambda c: (F.length("ops") - F.length(F.replace("ops", F.lit(c), F.lit("")))).cast("bigint")
    cluster = ["first_end", "last_end", "text_gaps", "pattern_gaps", marked("v").alias("n_missing"), marked("^").alias("n_extra")] if indels else []
    return hits.select(
        "entry_id", "pattern_id", "base_id", "strand", F.when(back, F.lit("REVCOMP")).otherwise(F.lit("FORWARD")).alias("strand_word"), "pattern", "forward_pattern",
        F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), (F.col("end_pos") - F.col("start_pos")).alias("length"), "edits",
        *five_and_three("start_pos", "end_pos", back), "text", F.when(back, S.reverse_complement("text")).otherwise(F.col("text")).alias("text_forward"),
        "ops", marked("|").alias("n_equal"), marked("*").alias("n_sub"), (F.length("text") - F.length("pattern")).cast("bigint").alias("length_difference"), *cluster,
    )


def five_and_three(start: str, end: str, back: Column) -> tuple[Column, Column]:
    """The 5' and the 3' coordinate of a hit: they change sides on the reverse strand."""
    return F.when(back, F.col(end)).otherwise(F.col(start)).alias("five"), F.when(back, F.col(start)).otherwise(F.col(end)).alias("three")


def counts_by_strand(hits: DataFrame, primers: DataFrame, k: int, both: bool = True) -> DataFrame:
    """base_id, strand, n_0 .. n_k, n of every primer and strand, 0 where it has no hit."""
    strands = match.both_strands(primers) if both else primers.select("pattern_id", F.col("pattern_id").alias("base_id"), F.lit("F").alias("strand"))
    counted = match.counts(hits, strands, k)
    return strands.select("pattern_id", "base_id", "strand").hint("merge").join(counted, "pattern_id").select("base_id", "strand", *(f"n_{i}" for i in range(k + 1)), "n")


def strand_aggregate(counted: DataFrame, k: int) -> DataFrame:
    """The counts of both strands of a primer added up."""
    return counted.groupBy("base_id").agg(*(F.sum(c).alias(c) for c in (*(f"n_{i}" for i in range(k + 1)), "n")))


def pcr_match(sequences: DataFrame, primers: DataFrame, k: int = 0, shortest: int = 0, longest: int = 2000, all_orientations: bool = False, sts: DataFrame | None = None, tolerance: int = 0, between: bool = False, indels: bool = False) -> DataFrame:
    """Amplicons of neighbouring primers (2p - 1 and 2p), each with up to k substitutions (with indels, edits), with letters and, where sizes are expected, deviance within the tolerance."""
    strands = match.both_strands(primers)
    n = primers.agg(F.max("pattern_id")).first()[0] or 0
    roles = primers.sparkSession.createDataFrame(pairs.roles(n, all_orientations), "pair_id bigint, left_id bigint, right_id bigint")
    if indels:
        hits = primer_match(sequences, primers, k, indels=True).select("entry_id", "pattern_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "edits")
    else:
        hits = match.mismatches(sequences, strands, k)
    found = pairs.amplicons(hits, roles, shortest, longest)
    if sts is not None:
        found = pairs.against_sizes(found, sts.select("pair_id", "size_lb", "size_ub"), tolerance)
    back = F.col("left_id") > n
    return pairs.with_sequence(found, sequences, between).withColumn("amplicon_forward", F.when(back, S.reverse_complement("amplicon")).otherwise(F.col("amplicon")))


def peptide_scan(proteins: DataFrame, peptides: DataFrame, changes: int = 0, context: int = 1, table: dict[str, float] | None = None) -> DataFrame:
    """Places of peptides that ``changes`` nucleotide changes at most turn into what stands there, with neighbours and the change of mass.

    Every substituted letter costs a change at least, so places with as many substitutions are found first and then costed.
    Neighbours are clipped at the entry's ends, which show as -.
    """
    hits = match.found(proteins, peptides, changes, None, context)
    costed = hits.withColumn("cost", S.mutation_cost(F.col("text"), F.col("pattern")) if changes else F.lit(0)).where(F.col("cost") <= changes)
    shown = lambda x: F.regexp_replace(x, f"{BEYOND}+", "-")
    delta = S.residue_mass("text", table) - S.residue_mass("pattern", table)
    return costed.select("entry_id", "pattern_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "pattern", "text", "edits", "cost", shown(F.col("before")).alias("left_context"), shown(F.col("after")).alias("right_context"), delta.alias("mass_difference"))


def unmatched_regions(sequences: DataFrame, matched: DataFrame, m: int) -> DataFrame:
    """entry_id, run, start, end, len, text: stretches of which no word of m letters is matched, each run of word starts with the m - 1 letters behind it. matched: entry_id, pos."""
    spans = sequences.select("entry_id", (F.length("seq") - m + 1).alias("size")).where("size > 0")
    return _regions(sequences, runs.complement(runs.islands(matched), spans), m)


def regions_of_words(sequences: DataFrame, starts: DataFrame, m: int) -> DataFrame:
    """The same of the words of m letters that are given themselves. starts: entry_id, pos."""
    return _regions(sequences, runs.islands(starts), m)


def _regions(sequences: DataFrame, gaps: DataFrame, m: int) -> DataFrame:
    gaps = cut(gaps.withColumn("run", F.row_number().over(Window.partitionBy("entry_id").orderBy("start")) - 1))
    if fits(entries := gaps.select("entry_id").distinct(), 8):  # only texts that have any are read again
        sequences = sequences.join(F.broadcast(entries), "entry_id", "left_semi")
    out = runs.extract(sequences, gaps.withColumn("length", F.col("len") + m - 1).select("entry_id", "run", "start", "length"))
    return out.select("entry_id", F.col("run").cast("bigint").alias("run"), F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("length")).cast("bigint").alias("end"), F.col("length").cast("bigint").alias("len"), "text")


def region_record(name: str = "name") -> Column:
    """Such a region as a FASTA record."""
    parts = (F.lit(">"), F.col(name), F.lit(" /run="), "run", F.lit(" /start="), "start", F.lit(" /end="), "end", F.lit(" /len="), "len", F.lit("\n"), "text")
    return F.concat(*(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))


def covering(span: int, k: int, weight: int) -> list[str]:
    """Templates of a span and weight such that any k substitutions leave one of them untouched: greedily, those that the fewest chosen ones serve first."""
    if weight > span - k:
        raise ValueError("k substitutions can touch every template of that weight")
    open_sets, chosen = {frozenset(x) for x in combinations(range(span), k)}, []
    every = [frozenset(x) for x in combinations(range(span), weight)]
    while open_sets:
        best = max(every, key=lambda t: (sum(not t & e for e in open_sets), sorted(t, reverse=True)))
        open_sets = {e for e in open_sets if best & e}
        chosen.append("".join("1" if i in best else "0" for i in range(span)))
    return chosen


def spaced_mismatches(sequences: DataFrame, patterns: DataFrame, k: int, templates: list[str]) -> DataFrame:
    """Up to k substitutions, by spaced seeds: places where a pattern's letters at a template's 1-positions stand, then the distance.

    All templates are of one span, no longer than any pattern; with those of ``covering`` no hit is missed.
    """
    span, known = len(templates[0]), match.facts(patterns)
    if match._few(patterns):  # all hits are found by comparing; templates then choose among them
        hits = match._compared(sequences, patterns.where(F.length("pattern") >= span), {n: [(0, n)] for n in known.lengths if n >= span}, k, 0, 0).where(~F.contains("around", F.lit(BEYOND)))
        stands = [S.template_word("around", F.lit(0), t) == S.template_word("pattern", F.lit(0), t) for t in templates]
        return hits.where(F.array_contains(F.array(*stands), True)).select("entry_id", "pattern_id", F.col("at").alias("start_pos"), (F.col("at") + F.length("pattern")).alias("end_pos"), "edits")
    longest = max([span, *known.lengths])
    keys = lambda x: F.explode(F.array(*(F.struct(F.lit(i).alias("tag"), S.template_word(x, F.lit(0), t).alias("mer")) for i, t in enumerate(templates))))
    wanted = patterns.where(F.length("pattern") >= span).select("pattern_id", "pattern", keys("pattern").alias("x")).select("pattern_id", "pattern", "x.*")
    rows = windows(sequences, 0, longest).select("entry_id", F.col("pos").cast("bigint").alias("pos"), "window", keys("window").alias("x")).select("entry_id", "pos", "window", "x.*")
    hit = match.looked_up(rows, wanted, ["tag", "mer"], len(templates) * sum(known.by_length.values()), 2 * longest).withColumnRenamed("pos", "start_pos")
    n = F.length("pattern")
    near = hit.withColumn("text", F.left("window", n)).where(~F.contains("text", F.lit(BEYOND)))
    near = near.withColumn("edits", S.hamming(F.col("text"), F.col("pattern"))).where(F.col("edits") <= k)
    return near.select("entry_id", "pattern_id", "start_pos", (F.col("start_pos") + n).alias("end_pos"), "edits").distinct()


def sampled(entries: DataFrame, share: float, seed: int = 0, key: str = "entry_id") -> DataFrame:
    """Each entry with that probability, by the md5 of seed and key, so that the sample does not depend on partitions."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return entries.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32)))


def melting_near(patterns: DataFrame, target: float, delta: float) -> DataFrame:
    """Patterns whose melting temperature is within delta of the target, with it."""
    return patterns.withColumn("tm", S.melting_temperature("pattern")).where(F.abs(F.col("tm") - target) <= delta)


def inexact_counts(sequences: DataFrame, patterns: DataFrame, k: int) -> DataFrame:
    """pattern_id, n_exact, n_inexact: hits without and with substitutions, 0 kept."""
    counted = match.counts(match.mismatches(sequences, patterns, k), patterns, k)
    return counted.select("pattern_id", F.col("n_0").alias("n_exact"), (F.col("n") - F.col("n_0")).alias("n_inexact"))


def alphabet(sequences: DataFrame) -> DataFrame:
    """symbol, n, code: the letters of all entries, how often, and their place in the order of letters (from 0); partial counts of each entry before the shuffle."""
    letters = sequences.select(F.explode(F.array_distinct(F.split("seq", ""))).alias("symbol"), "seq").where("symbol != ''")
    counted = letters.select("symbol", (F.length("seq") - F.length(F.replace("seq", F.col("symbol"), F.lit("")))).alias("k")).groupBy("symbol").agg(F.sum("k").alias("n"))
    return counted.withColumn("code", F.row_number().over(Window.orderBy("symbol")) - 1)  # one row a letter


def checked(sequences: DataFrame, letters: str) -> DataFrame:
    """One row: entries, letters, letters outside of the given ones, the longest entry, empty entries."""
    strange = F.length(F.translate("seq", letters, ""))
    return sequences.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("letters"), F.coalesce(F.sum(strange), F.lit(0)).alias("strange"), F.coalesce(F.max(F.length("seq")), F.lit(0)).cast("bigint").alias("longest"), F.count_if(F.length("seq") == 0).alias("empty"))

