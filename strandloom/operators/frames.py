"""Peptides in the six frames of DNA, with costs in nucleotide changes.

A codon is one letter of an alphabet of 64, so a frame is a text like any other: it is made of pieces of an entry that overlap and keep their phase,
three frames a strand, and no entry is translated whole. Peptides are looked up by their amino acids, costs are taken from the codons that stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from . import match
from .kmers import BEYOND

_BASES = "TCAG"
#: A letter for each codon in the order of ``seq.CODE``, and for what is no codon.
CODONS, UNKNOWN = "".join(chr(48 + i) for i in range(64)), "~"
#: Codons that a piece owns on each frame, and letters of the first cut (a multiple of three times that).
OWN = 64
FAR = 3 * OWN * 170


def amino_acids(codons: Column | str) -> Column:
    return F.translate(S.column(codons), CODONS + UNKNOWN, S.CODE + "X")


def _turned(code: int) -> str:
    """The codon that is read at the same place on the other strand: T and A, C and G are 0 and 2, 1 and 3."""
    a, b, c = code // 16, code // 4 % 4, code % 4
    return CODONS[16 * (c ^ 2) + 4 * (b ^ 2) + (a ^ 2)]


def turned(codons: Column | str) -> Column:
    """The codons of the reverse complement of the same letters."""
    return F.reverse(F.translate(S.column(codons), CODONS, "".join(map(_turned, range(64)))))


def codon_strings(dna: Column | str) -> Column:
    """Three texts of codon letters: the whole codons from the first, second and third letter on."""
    place = lambda c: F.instr(F.lit(_BASES), c)
    digits = F.transform(F.split(F.translate(F.upper(S.column(dna)), "U", "T"), ""), lambda c: F.when(place(c) > 0, place(c) - 1))
    rest = lambda a, i: F.slice(a, F.lit(i), F.greatest(F.size(a) - i + 1, F.lit(0)))

    def coded(d: Column) -> Column:
        pairs = F.zip_with(d, rest(d, 2), lambda x, y: 4 * x + y)
        return F.slice(F.zip_with(pairs, rest(d, 3), lambda x, y: 4 * x + y), F.lit(1), F.greatest(F.size(d) - 2, F.lit(0)))

    codes = F.transform(F.array(digits), coded)[0]
    shown = F.transform(codes, lambda c: F.when(c.between(0, 63), F.substring(F.lit(CODONS), c + 1, F.lit(1))).otherwise(F.lit(UNKNOWN)))
    strided = lambda a: F.array(*(F.array_join(F.filter(a, lambda _, i: i % 3 == f), "") for f in range(3)))
    return F.transform(F.array(shown), strided)[0]


def frame_pieces(sequences: DataFrame, letters: int, context: int = 0) -> DataFrame:
    """entry_id, seq: codon texts of all frames. entry_id is a struct of the entry, its length n, the strand, the 0-based place of the piece's first codon
    on the forward strand, how many codons it has, and from which to which forward codon a stretch must start to belong to the piece.

    letters: amino acids of the longest peptide. A stretch of up to so many, with ``context`` codons on both sides, lies whole in the piece that owns its first codon.
    """
    before, behind = 3 * context, 3 * (letters - 1 + context) + 2
    cut = lambda text, size: F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = sequences.select("entry_id", F.length("seq").alias("n"), "seq", F.explode(cut("seq", FAR)).alias("far"))
    part_from = F.greatest(F.col("far") - before, F.lit(0))
    rows = rows.select("entry_id", "n", "far", part_from.alias("part_from"), F.substring("seq", part_from + 1, F.col("far") - part_from + FAR + behind).alias("part"))
    rows = rows.select("entry_id", "n", "part_from", "part", F.explode(F.sequence("far", F.least(F.col("far") + FAR, F.col("n")) - 1, F.lit(3 * OWN))).alias("near"))
    first = F.greatest(F.col("near") - before, F.lit(0))
    rows = rows.select("entry_id", "n", "near", first.alias("first"), F.substring("part", first - F.col("part_from") + 1, F.col("near") - first + 3 * OWN + behind).alias("piece"))
    rows = rows.select("entry_id", "n", "near", "first", F.posexplode(codon_strings("piece")).alias("phase", "codons")).where("codons != ''")
    held = F.floor((F.col("near") - F.col("first")) / 3).cast("int")
    key = lambda strand: F.struct("entry_id", "n", F.lit(strand).alias("strand"), (F.col("first") + F.col("phase")).alias("place"), F.length("codons").alias("held"), held.alias("low"), (held + OWN).alias("high"))
    both = F.array(F.struct(key(0).alias("entry_id"), F.col("codons").alias("seq")), F.struct(key(1).alias("entry_id"), turned("codons").alias("seq")))
    return rows.select(F.explode(both).alias("x")).select("x.entry_id", "x.seq")


#: Fewest changes from a codon to any codon of an amino acid, 21 to a codon, in the order of these letters.
_AMINO = "".join(sorted(set(S.CODE)))


def codon_cost(codons: Column | str, peptide: Column | str) -> Column:
    """Sum of the nucleotide changes that turn codons (as letters of CODONS) into some codons of a peptide of the same length; what is no codon or amino acid costs 3."""
    flat = F.lit([S.codon_amino_distance(a + b + c, x) for a in _BASES for b in _BASES for c in _BASES for x in _AMINO])
    at = lambda c, x: F.get(flat, (F.instr(F.lit(CODONS), c) - 1) * len(_AMINO) + F.instr(F.lit(_AMINO), x) - 1)
    known = lambda c, x: (F.instr(F.lit(CODONS), c) > 0) & (F.instr(F.lit(_AMINO), x) > 0)
    costs = F.zip_with(F.split(S.column(codons), ""), F.split(S.column(peptide), ""), lambda c, x: F.when(known(c, x), at(c, x)).otherwise(F.lit(3)))
    return F.aggregate(costs, F.lit(0), lambda s, x: s + x)


def peptides_in_frames(sequences: DataFrame, peptides: DataFrame, changes: int = 0, context: int = 0) -> DataFrame:
    """entry_id, pattern_id, pattern, frame, aa_start, dna_start, dna_end, text, edits, cost, left_context, right_context of every place, on any of the six frames,
    whose codons ``changes`` nucleotide changes at most turn into a peptide.

    Frames 0 to 2 read the forward strand from that letter on, 3 to 5 the reverse complement; aa_start counts on the frame, dna_start and dna_end on the forward strand.
    text: the amino acids there; edits: how many differ. A changed amino acid costs a change at least, so places with as many differences are found first.
    Contexts are the amino acids on both sides, - beyond the frame.
    """
    ns = match.facts(peptides).lengths
    if not ns:
        return sequences.sparkSession.createDataFrame([], "entry_id bigint, pattern_id bigint, pattern string, frame int, aa_start bigint, dna_start bigint, dna_end bigint, text string, edits int, cost int, left_context string, right_context string")
    m = F.length("pattern")
    hits = match.found(frame_pieces(sequences, ns[-1], context), peptides, changes, None, context, amino_acids)
    hits = hits.withColumnRenamed("text", "codons").withColumnRenamed("start_pos", "at").withColumn("text", amino_acids("codons"))
    key = lambda c: F.col(f"entry_id.{c}")
    forward_codon = F.when(key("strand") == 0, F.col("at")).otherwise(key("held") - F.col("at") - m)
    hits = hits.where((forward_codon >= key("low")) & (forward_codon < key("high"))).withColumn("dna_start", (key("place") + 3 * forward_codon).cast("bigint"))
    hits = hits.withColumn("dna_end", F.col("dna_start") + 3 * m).withColumn("cost", codon_cost("codons", "pattern") if changes else F.lit(0)).where(F.col("cost") <= changes)
    off = F.when(key("strand") == 0, F.col("dna_start")).otherwise(key("n") - F.col("dna_end"))
    shown = lambda x: F.regexp_replace(amino_acids(x), f"{BEYOND}+", "-")
    sides = F.col("before"), F.col("after")
    return hits.select(
        key("entry_id").alias("entry_id"), "pattern_id", "pattern", (3 * key("strand") + off % 3).cast("int").alias("frame"), F.floor(off / 3).cast("bigint").alias("aa_start"), "dna_start", "dna_end",
        "text", "edits", "cost", shown(sides[0]).alias("left_context"), shown(sides[1]).alias("right_context"),
    ).distinct()
